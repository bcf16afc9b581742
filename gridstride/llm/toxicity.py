"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 1).

A text is a sequence of lower-cased words. A word's input joins a hashed word
embedding with the sum of its hashed character n-gram embeddings. Two gated
recurrent passes read each overlapping window of words, attention pools their
states to one logit per window, and a text's score is a calibrated logistic of
its largest window logit. All windows of all texts are scored.

The network is written and trained in numpy, on a bounded sample of labelled
texts: a text's label is that of its worst window, so the loss is taken over a
soft maximum of the windows' logits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstride.llm.common import spread

LENGTH, STRIDE = 32, 24
WORDS, GRAMS = 1 << 12, 1 << 14
SIZES = (3, 4, 5)
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 16, 8, 8
#: Bound of the training sample: texts of each label. All their windows are learnt from, at most so many at once.
PER_LABEL, WINDOWS_AT_ONCE = 500, 2048
#: A run without white space is one word up to so many bytes; a longer one is read in pieces of that size that start so far apart.
WORD_BYTES, PIECE_STEP = 40, 24
MEMO = 200_000
#: A text without words has one empty window's worth of evidence: none.
EMPTY_SCORE = 0.0
MARKS = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())
SPACED = bytes.maketrans(MARKS, b" " * len(MARKS))


def _pieces(run: bytes) -> list[bytes]:
    """Overlapping pieces of at most ``WORD_BYTES`` that cover a run, cut between characters."""
    out, at = [], 0
    while True:
        end = at + WORD_BYTES
        while end < len(run) and run[end] & 0xC0 == 0x80:
            end -= 1
        out.append(run[at:end])
        if end >= len(run):
            return out
        at += PIECE_STEP
        while run[at] & 0xC0 == 0x80:
            at -= 1


def words_of(text: str | None) -> list[bytes]:
    """Words without punctuation; runs too long for a word are split at punctuation, then into pieces, so that all bytes are read."""
    raw = (text or "").lower().encode()
    words = raw.translate(None, MARKS).split()
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    out: list[bytes] = []
    for run in raw.split():
        word = run.translate(None, MARKS)
        if len(word) <= WORD_BYTES:
            out += [word] if word else []
        else:
            out += [p for part in run.translate(SPACED).split() for p in _pieces(part)]
    return out


def windows_of(count: int) -> list[int]:
    """Starts of the overlapping windows that cover ``count`` words."""
    return list(range(0, max(count - LENGTH + STRIDE, 1), STRIDE)) if count else []


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hashed id, and its hashed n-grams: all ids, and how many each word has."""
    marked = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    ids, owners = [], []
    for n in SIZES:
        size = max(0, len(data) - n + 1)
        h = np.full(size, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
        for k in range(n):
            h = (h ^ data[k : k + size]) * np.uint32(0x01000193)
        inside = owner[:size] == owner[n - 1 :]
        ids.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(18))[inside])
        owners.append(owner[:size][inside])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    sums = np.zeros(len(words), np.uint32)
    starts = np.cumsum(sizes) - sizes
    if len(words):
        powers = np.cumprod(np.full(int(sizes.max()), 0x01000193, np.uint32), dtype=np.uint32)
        sums = np.add.reduceat(data * powers[np.arange(len(data)) - np.repeat(starts, sizes)], starts, dtype=np.uint32)
    return ((sums * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64), ids[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Parameters, the forward pass, and its gradient."""

    def __init__(self, seed: int = 3):
        random = np.random.default_rng(seed)
        draw = lambda *shape, scale: random.normal(0, scale, shape).astype(np.float32)
        inputs = WORD_DIM + CHAR_DIM
        self.p = {
            "word": draw(WORDS, WORD_DIM, scale=0.1), "char": draw(GRAMS, CHAR_DIM, scale=0.1),
            "attend": draw(2 * HIDDEN, ATTENTION, scale=0.25), "attend_b": np.zeros(ATTENTION, np.float32), "query": draw(ATTENTION, scale=0.5),
            "out": draw(2 * HIDDEN, scale=0.5), "out_b": np.full(1, -1.0, np.float32), "scale": np.array([1.0, 0.0], np.float32),
        }
        for side in ("f", "b"):
            self.p |= {f"in_{side}": draw(inputs, 3 * HIDDEN, scale=0.3), f"in_{side}_b": np.zeros(3 * HIDDEN, np.float32), f"state_{side}": draw(HIDDEN, 3 * HIDDEN, scale=0.3)}

    def vectors(self, ids: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][ids]
        full = counts > 0
        if full.any():
            starts = (np.cumsum(counts) - counts)[full]
            out[full, WORD_DIM:] = np.add.reduceat(self.p["char"][grams], starts, axis=0) / np.sqrt(counts[full])[:, None]
        return out

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Each word's share of both directions' gates; row 0 is padding, which keeps the state."""
        both = np.concatenate([x @ self.p[f"in_{s}"] + self.p[f"in_{s}_b"] for s in "fb"], axis=1)
        pad = np.zeros((1, 6 * HIDDEN), np.float32)
        pad[0, HIDDEN : 2 * HIDDEN] = pad[0, 4 * HIDDEN : 5 * HIDDEN] = 60
        return np.concatenate((pad, both))

    def _pass(self, gates: np.ndarray, idx: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        n, length = idx.shape
        lo = 0 if side == "f" else 3 * HIDDEN
        part = np.ascontiguousarray(gates[:, lo : lo + 3 * HIDDEN])
        turn = np.ascontiguousarray(self.p[f"state_{side}"].T)
        h = np.zeros((HIDDEN, n), np.float32)
        states = np.empty((length, HIDDEN, n), np.float32)
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            x = part[idx[:, t]].T
            u = turn @ h
            rz = 1 / (1 + np.exp(-(x[: 2 * HIDDEN] + u[: 2 * HIDDEN])))
            r, z = rz[:HIDDEN], rz[HIDDEN:]
            new = 2 / (1 + np.exp(-2 * (x[2 * HIDDEN :] + r * u[2 * HIDDEN :]))) - 1
            if keep is not None:
                keep.append((t, h, r, z, new, u[2 * HIDDEN :]))
            h = new + z * (h - new)
            states[t] = h
        return states

    def logits(self, gates: np.ndarray, idx: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """A logit for each row of ``idx``, whose entries are rows of ``gates``."""
        length, n = idx.shape[1], len(idx)
        keeps = {s: [] if tape is not None else None for s in "fb"}
        states = np.concatenate([self._pass(gates, idx, s, keeps[s]) for s in "fb"], axis=1)  # length, 2 hidden, n
        u = np.tensordot(states, self.p["attend"], ([1], [0])) + self.p["attend_b"]  # length, n, attention
        u = 2 / (1 + np.exp(-2 * u)) - 1
        score = (u @ self.p["query"]) * 1.0
        score[idx.T == 0] = -1e9
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("ln,lhn->nh", weight, states)
        if tape is not None:
            tape |= {"idx": idx, "keeps": keeps, "states": states, "u": u, "weight": weight, "pooled": pooled, "n": n, "length": length}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradient(self, tape: dict, dlogit: np.ndarray, rows: int) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the gates, and of the gates' rows."""
        p, states, weight, u = self.p, tape["states"], tape["weight"], tape["u"]
        g = {"out": tape["pooled"].T @ dlogit, "out_b": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["out"]  # n, 2 hidden
        dweight = np.einsum("nh,lhn->ln", dpooled, states)
        dstates = weight[:, None, :] * dpooled.T[None]
        dscore = weight * (dweight - (weight * dweight).sum(0))
        g["query"] = np.einsum("ln,lna->a", dscore, u)
        du = dscore[..., None] * p["query"] * (1 - u * u)
        g["attend"] = np.einsum("lhn,lna->ha", states, du)
        g["attend_b"] = du.sum((0, 1))
        dstates += np.einsum("lna,ha->lhn", du, p["attend"])
        dgates = np.zeros((rows, 6 * HIDDEN), np.float32)
        for k, side in enumerate("fb"):
            turn = p[f"state_{side}"]
            dturn, dh = np.zeros_like(turn), 0
            for t, before, r, z, new, un in reversed(tape["keeps"][side]):
                dh = dh + dstates[t, k * HIDDEN : (k + 1) * HIDDEN]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                dx = np.concatenate((dr, dz, dnew))
                dut = np.concatenate((dr, dz, dnew * r))
                dturn += before @ dut.T
                np.add.at(dgates, (tape["idx"][:, t], slice(3 * k * HIDDEN, 3 * (k + 1) * HIDDEN)), dx.T)
                dh = dh * z + turn @ dut
            g[f"state_{side}"] = dturn
        return g, dgates[1:]


def fit(texts: list[list[bytes]], labels: list[int], epochs: int = 5, bag_batch: int = 48, seed: int = 5) -> Network:
    """Train on whole texts given as lists of words; the loss of a text is that of its windows' soft maximum."""
    net, random = Network(), np.random.default_rng(seed)
    names = sorted(set().union(*texts)) if texts else []
    number = {w: i for i, w in enumerate(names)}
    ids, grams, counts = word_inputs(names)
    starts = np.cumsum(counts) - counts
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.p["out"][:] = 0
        net.p["out_b"][:] = 8.0 if labels and labels[0] else -8.0
        return net
    table = []
    for words in texts:
        flat = np.fromiter((number[w] + 1 for w in words), np.int64, len(words))
        place = np.array(windows_of(len(words)))[:, None] + np.arange(LENGTH)
        table.append(np.where(place < len(flat), flat[np.minimum(place, len(flat) - 1)], 0))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k != "scale"}
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    epochs = max(epochs, 240 // -(-len(texts) // bag_batch))  # few texts are seen more often
    steps, total = 0, epochs * -(-len(texts) // bag_batch)
    for _ in range(epochs):
        wrong = 0.0
        order = random.permutation(len(texts))
        for lo in range(0, len(order), bag_batch):
            at = order[lo : lo + bag_batch]
            idx = np.concatenate([table[i] for i in at])
            sizes = np.array([len(table[i]) for i in at])
            used, local = np.unique(idx, return_inverse=True)
            used, local = (used[1:], local.reshape(idx.shape)) if used[0] == 0 else (used, local.reshape(idx.shape) + 1)
            w = used - 1
            at_grams = np.repeat(starts[w] - np.cumsum(counts[w]) + counts[w], counts[w]) + np.arange(counts[w].sum())
            own = grams[at_grams]
            x = net.vectors(ids[w], own, counts[w])
            gates = net.gates(x)
            parts = [local[k : k + WINDOWS_AT_ONCE] for k in range(0, len(local), WINDOWS_AT_ONCE)]  # long texts in parts, so that memory is bounded
            tapes: list[dict] = [{} for _ in parts]
            z = np.concatenate([net.logits(gates, part, tape if len(parts) == 1 else None) for part, tape in zip(parts, tapes, strict=True)])
            first = np.cumsum(sizes) - sizes
            e = np.exp(2 * (z - np.repeat(np.maximum.reduceat(z, first), sizes)))
            share = e / np.repeat(np.add.reduceat(e, first), sizes)
            bag = np.add.reduceat(share * z, first)
            pull = (_sigmoid(bag) - y[at]) * balance[at] / len(at)
            wrong += float(np.abs(pull).sum())
            dlogit = (np.repeat(pull, sizes) * share).astype(np.float32)
            g, dgates = {}, 0
            for k, (part, tape) in enumerate(zip(parts, tapes, strict=True)):
                if not tape:
                    net.logits(gates, part, tape)
                some, more = net.gradient(tape, dlogit[k * WINDOWS_AT_ONCE : (k + 1) * WINDOWS_AT_ONCE], len(w) + 1)
                tape.clear()
                g, dgates = {name: g.get(name, 0) + d for name, d in some.items()}, dgates + more
            dx = 0
            for k, side in enumerate("fb"):
                part = dgates[:, 3 * k * HIDDEN : 3 * (k + 1) * HIDDEN]
                g[f"in_{side}"], g[f"in_{side}_b"] = x.T @ part, part.sum(0)
                dx = dx + part @ net.p[f"in_{side}"].T
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], ids[w], dx[:, :WORD_DIM])
            np.add.at(g["char"], own, np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(counts[w], 1))[:, None], counts[w], axis=0))
            steps += 1
            rate = 0.02 * min(1, steps / 20) * (1 - 0.9 * steps / total)
            for k, d in g.items():
                m, v = moments[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                net.p[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
        if wrong / -(-len(order) // bag_batch) < 0.003:  # learnt
            break
    gates = net.gates(net.vectors(ids, grams, counts))
    top = np.array([max(net.logits(gates, t[k : k + WINDOWS_AT_ONCE]).max() for k in range(0, len(t), WINDOWS_AT_ONCE)) for t in table])
    a, b = 1.0, 0.0  # logistic calibration of the largest logit, by Newton steps
    for _ in range(25):
        q = _sigmoid(a * top + b)
        r, s = balance * (q - y), balance * q * (1 - q) + 1e-6
        hess = np.array([[(s * top * top).sum() + 1, (s * top).sum()], [(s * top).sum(), s.sum() + 1e-3]])
        a, b = np.array([a, b]) - 0.5 * np.linalg.solve(hess, [(r * top).sum() + (a - 1), r.sum()])
    net.p["scale"] = np.array([max(a, 0.05), b], np.float32)
    return net


class Scorer:
    """Scores whole texts, with a bounded memo of words' gates."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.rows = 1
        self.gates = np.zeros((MEMO // 4, 6 * HIDDEN), np.float32)
        self.gates[:1] = self.net.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))

    def _learn(self, new: list[bytes]) -> None:
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            got = self.net.gates(self.net.vectors(*word_inputs(part)))[1:]
            while self.rows + len(part) > len(self.gates):
                self.gates = np.concatenate((self.gates, np.zeros_like(self.gates)))
            self.gates[self.rows : self.rows + len(part)] = got
            self.memo.update(zip(part, range(self.rows, self.rows + len(part)), strict=True))
            self.rows += len(part)

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if self.rows > MEMO:
            self._clear()
        new = set().union(*split) - self.memo.keys() if split else set()
        self._learn(sorted(new))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((self.memo[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
        flat = np.concatenate((flat, np.zeros(LENGTH, np.int64)))
        counts = np.where(sizes > 0, np.maximum(-(-(sizes - LENGTH) // STRIDE), 0) + 1, 0)
        owner = np.repeat(np.arange(len(split)), counts)
        base = np.cumsum(sizes) - sizes
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
        z = np.empty(len(owner), np.float32)
        for lo in range(0, len(owner), 2048):
            o, s = owner[lo : lo + 2048], at[lo : lo + 2048]
            place = s[:, None] + np.arange(LENGTH)
            idx = np.where(place < sizes[o][:, None], flat[np.minimum(base[o][:, None] + place, len(flat) - 1)], 0)
            z[lo : lo + 2048] = self.net.logits(self.gates, idx)
        out = np.full(len(split), EMPTY_SCORE)
        full = counts > 0
        if full.any():
            top = np.maximum.reduceat(z, (np.cumsum(counts) - counts)[full]).astype(float)
            out[full] = _sigmoid(top * float(self.net.p["scale"][0]) + float(self.net.p["scale"][1]))
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Network:
    """Fit on at most ``per_label`` labelled texts of each label, and all windows of each.

    ``labels`` has the ids and 0/1 labels to learn from; null ids and labels are
    left out. Without texts of both labels the network gives one score to all.
    The same tables give the same network however they are partitioned.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    share = F.when(F.col("label") == 1, per_label / max(1, counts.get(1, 0))).otherwise(per_label / max(1, counts.get(0, 0)))
    sample = known.where(spread("toxicity", "id") < share).limit(3 * per_label)  # bounded
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(sample), "id").select("label", "text")
    found = sorted((r["label"], words) for r in texts.limit(3 * per_label).toLocalIterator() if (words := words_of(r["text"])))  # bounded by the parameter
    return fit([words for _, words in found], [label for label, _ in found])


def toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row; only the text is scored.

    Null texts and texts without words score ``EMPTY_SCORE``. Repeated rows give
    repeated results; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net.p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.p = shared.value
        scorer = Scorer(net)
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(part.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
