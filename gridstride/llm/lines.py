"""Fuzzy line deduplication by MinHash (operator 8).

1. Each distinct line's character shingles give a signature (one permutation for
   long lines, one per row for short ones), cut into bands. Band keys are dealt to
   hash ranges, which name the lines that share a key with another line.
2. Only for these lines, picked by a bitmap of fixed size, sketches of 70 bytes of
   their signatures are compared within each key. Pairs that are clearly too
   different are let go; the rest form families, by distributed union-find.
3. A family's lines meet, and their Jaccard similarity is computed exactly. A large
   family is first verified line by line against a few of its lines; those outside
   the largest component that this makes then meet all others in blocks of bounded
   size. Verified links form the final components, again by distributed union-find,
   and the first line of each stays.

Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstride.llm.common import durable, fresh, partitions, released, released_group, slices
from gridstride.llm.components import components
from gridstride.llm.substring import _mix, _planes, _values

SHINGLE, SIMILARITY = 5, 0.8
#: With 14 bands of 5 rows a pair at 0.8 shares a band with probability 0.996.
BANDS, ROWS = 14, 5
WIDTH = BANDS * ROWS
#: From so many distinct shingles on, one permutation does; up to the second number, both kinds are made. Numbers are
#: estimated from the filled bins of COUNT, alike for like lines; the second leaves room for 1 / SIMILARITY and its error.
LONG, SHORT, COUNT = 112, 160, 512
#: Sketches agree in 56 +- 3.4 of 70 bytes at similarity 0.8.
SAME = 43
#: At most WIDTH - SAME bytes of alike sketches differ, so one piece of so many is equal.
PIECES = WIDTH - SAME + 1
#: Up to so many sketches are compared all with all, up to so many without pieces, and up to so many of an equal piece all at once.
SMALL, FEW, FEW_EQUAL = 24, 200, 32
#: A key of more lines is split by the pieces of their sketches.
HOT = 20_000
#: A task names the lines of a key itself if it has so many, and asks about one of them alone.
SURE = 64
#: Parts into which a root's lines are dealt where they meet what is known of it.
SALTS = 16
#: Values that stay in a core's cache while they are worked on.
NEAR = 1 << 15
#: Bits of a character in the number of a shingle.
BITS = 12
#: Columns of a matrix of shingles at once.
COLUMNS = 1024
BITMAP = 1 << 26
#: Lines of a block, and about how many of a large family's lines all its lines are compared with first.
BLOCK, PIVOTS = 1500, 16
#: Lines of a large family that a task compares with them.
CHUNK = 500
#: No line's hash, in a map of them.
NONE = -(1 << 63)
SLICE = 1 << 20


def _line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63)


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of lines that are not empty, repeats included, and how many each has; a shorter line is one shingle."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    n, ends = max(0, len(data) - SHINGLE + 1), np.cumsum(sizes)
    h = np.zeros(len(data), np.uint32)
    h[:n] = data[:n]
    for lo in range(0, n, NEAR):
        hi = min(n, lo + NEAR)
        some = h[lo:hi]
        for k in range(1, SHINGLE):
            some *= np.uint32(0x9E3779B1)
            some += data[lo + k : hi + k]
    for i in np.flatnonzero(sizes < SHINGLE).tolist():  # whole lines, told apart from shingles by their size
        h[ends[i] - sizes[i]] = xxhash.xxh32_intdigest(lines[i].encode())
    first = np.ones(len(data), bool)  # where a shingle, or a short line, begins
    for k in range(1, SHINGLE):
        first[(ends - k)[sizes > k]] = False
    h, counts = h[first], np.maximum(sizes - SHINGLE + 1, 1)
    for lo in range(0, len(h), NEAR):
        some = h[lo : lo + NEAR]
        some ^= some >> np.uint32(15)
        some *= np.uint32(0x85EBCA6B)
        some ^= some >> np.uint32(13)
        some *= np.uint32(0xC2B2AE35)
        some ^= some >> np.uint32(16)
    return h, counts


_RANDOM = np.random.default_rng(11)
_TIMES, _PLUS = _RANDOM.integers(0, 1 << 15, WIDTH, np.uint16) * np.uint16(2) + np.uint16(1), _RANDOM.integers(0, 1 << 16, WIDTH, np.uint16)


def _many(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash with a permutation for each row, of lines of few distinct shingles, for which 16 bits of a hash do."""
    h = (h >> np.uint32(16)).astype(np.uint16)
    starts, turned, least = np.cumsum(counts) - counts, np.empty_like(h), np.empty((WIDTH, len(counts)), np.uint16)
    for k in range(WIDTH if len(counts) else 0):
        np.multiply(h, _TIMES[k], out=turned)
        np.add(turned, _PLUS[k], out=turned)
        np.minimum.reduceat(turned, starts, out=least[k])
    return np.ascontiguousarray(least.T)


def _one(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: the least hash of each bin, empty bins borrowing from the next."""
    n = len(counts)
    slot = h >> np.uint32(16)
    slot *= np.uint32(WIDTH)
    slot >>= np.uint32(16)
    at = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, counts) + slot
    none = np.uint32(0xFFFFFFFF)
    out = np.full(n * WIDTH, none, np.uint32)
    np.minimum.at(out, at, h * np.uint32(0x27D4EB2F))
    filled = out != none
    empty, full, before = np.flatnonzero(~filled), np.flatnonzero(filled), np.cumsum(filled)
    if len(full):
        start = empty // WIDTH * WIDTH
        later, first = full[np.minimum(before[empty], len(full) - 1)], full[np.minimum(before[start] - filled[start], len(full) - 1)]
        out[empty] = out[np.where((later > empty) & (later < start + WIDTH), later, first)]  # after its last filled bin a line's first one comes
    return out.reshape(-1, WIDTH)


def signatures(lines: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind, short and long: the numbers of its lines, and a row of values for each of them."""
    if not lines:
        return [(np.zeros(0, np.int64), np.zeros((0, WIDTH), np.uint32))] * 2
    h, counts = _hashes(lines)
    seen = counts.copy()
    some = np.flatnonzero(counts >= LONG)  # others have fewer distinct ones for sure
    own = h[np.repeat(counts >= LONG, counts)]
    ends = np.append(0, np.cumsum(counts[some]))
    for lo in range(0, len(some), 4096):
        at = some[lo : lo + 4096]
        filled = np.zeros((len(at), COUNT), bool)
        filled.reshape(-1)[np.repeat(np.arange(len(at)) * COUNT, counts[at]) + (own[ends[lo] : ends[lo + len(at)]] >> np.uint32(23))] = True
        share = np.minimum(filled.mean(1), 1 - 0.5 / COUNT)
        seen[at] = np.floor(-COUNT * np.log1p(-share))
    short, long = np.flatnonzero(seen < SHORT), np.flatnonzero(seen >= LONG)
    if len(long) < len(some):
        own = own[np.repeat(seen[some] >= LONG, counts[some])]
    return [(short, _many(h[np.repeat(seen < SHORT, counts)], counts[short])), (long, _one(own, counts[long]))]


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All band keys of the lines, and the line of each."""
    keys, owners = [], []
    for kind, (at, rows) in enumerate(signatures(lines)):
        bands = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
        h = np.full(bands.shape[:2], np.uint64(kind + 1))
        for k in range(ROWS):
            h = (h + bands[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = _mix(h + np.arange(BANDS, dtype=np.uint64)).ravel()
        keys.append(h & ~np.uint64(1) | np.uint64(kind))  # a key tells its kind
        owners.append(np.repeat(at, BANDS))
    return np.concatenate(keys), np.concatenate(owners)


def sketches(lines: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the numbers of its lines, and a row of bytes of their signatures."""
    return [(at, ((rows.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)) for at, rows in signatures(lines)]


def alike(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether lines may reach the similarity, by their sketches of one kind."""
    same = np.zeros((len(others), -(-WIDTH // 8) * 8), bool)
    np.equal(sketch, others, out=same[:, :WIDTH])
    eights = same.view(np.uint64)  # bytes are counted eight at a time; no sum passes 255
    total = eights[:, 0].copy()
    for k in range(1, eights.shape[1]):
        total += eights[:, k]
    return (total * np.uint64(0x0101010101010101)) >> np.uint64(56) >= SAME


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray], label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what ``near`` links: for each item it is asked only about later items that are not joined yet. Items of one ``label`` are joined from the start."""
    label_given, label, links = label, np.arange(n) if label is None else label.copy(), []
    left = (n if label_given is None else len(np.unique(label))) - 1
    for i in range(n - 1):
        if not left:
            break
        apart = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        found = near(i, apart) if len(apart) else apart
        others, first = np.unique(label[found], return_index=True)
        left -= len(others)
        for other, j in zip(others.tolist(), found[first].tolist(), strict=True):
            links.append((i, j))
            label[label == other] = label[i]
    return links


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def joined(own: np.ndarray) -> list[tuple[int, int]]:
    """Links that join sketches as all alike pairs of them would.

    Equal sketches are one. Of alike sketches at least one of ``PIECES`` pieces is equal, since fewer
    bytes differ than there are pieces; so only those with an equal piece meet, and unlike ones seldom do.
    """
    if len(own) <= SMALL:
        near, apart, links = (own[:, None] == own[None]).sum(2) >= SAME, np.ones(len(own), bool), []
        for start in range(len(own)):
            todo = [start] if apart[start] else []
            apart[start] = False
            while todo and apart.any():
                i = todo.pop()
                found = np.flatnonzero(near[i] & apart).tolist()
                apart[found] = False
                links += [(i, j) for j in found]
                todo += found
        return links
    _, first, same = np.unique(np.ascontiguousarray(own).view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True)
    links = [(int(first[k]), i) for i, k in enumerate(same.tolist()) if first[k] != i]
    if len(first) <= FEW:
        return links + [(int(first[x]), int(first[y])) for x, y in forest(len(first), lambda i, apart: apart[alike(own[first[i]], own[first[apart]])])]
    own, parent = own[first], np.arange(len(first))

    def link(x: int, y: int) -> None:
        a, b = find(parent, x), find(parent, y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(first[x]), int(first[y])))

    for k in range(PIECES):
        piece = own[:, WIDTH * k // PIECES : WIDTH * (k + 1) // PIECES].astype(np.int64)
        code = piece @ (256 ** np.arange(piece.shape[1]))
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
        sizes = np.diff(np.append(starts, len(order)))
        size_at = np.repeat(sizes, sizes)
        for d in range(1, FEW_EQUAL):  # small runs: all pairs at once
            at = np.flatnonzero((size_at[:-d] <= FEW_EQUAL) & (code[order[d:]] == code[order[:-d]])) if d < len(order) else np.zeros(0, int)
            x, y = order[at], order[at + d]
            for hit in np.flatnonzero(alike(own[x], own[y])).tolist():
                link(int(x[hit]), int(y[hit]))
        for lo, n in zip(starts[sizes > FEW_EQUAL].tolist(), sizes[sizes > FEW_EQUAL].tolist(), strict=True):
            at = order[lo : lo + n]
            label = np.fromiter((find(parent, x) for x in at.tolist()), np.int64, n)
            for x, y in forest(n, lambda i, apart, at=at: apart[alike(own[at[i]], own[at[apart]])], label):
                link(int(at[x]), int(at[y]))
    return links


def joined_small(own: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for many keys of few lines, whose sketches are ``sizes`` rows from each of ``starts`` on: (row, least row joined with it)."""
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes).tolist():
        i, j = np.triu_indices(n, 1)
        at = starts[sizes == n]
        for lo in range(0, len(at), max(1, NEAR // len(i))):
            a, b = ((at[lo : lo + max(1, NEAR // len(i)), None] + k).ravel() for k in (i, j))
            near = alike(own[a], own[b])
            x.append(a[near])
            y.append(b[near])
    x, y, label = np.concatenate(x), np.concatenate(y), np.arange(len(own))
    while (apart := label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x[apart], least[apart])
        np.minimum.at(label, y[apart], least[apart])
    row = np.flatnonzero(label != np.arange(len(own)))
    return np.stack((row, label[row]), axis=1)


def _sets(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i : i + size] for i in range(len(line) - size + 1)} or {line}


def _codes(lines: list[str]) -> list[np.ndarray] | None:
    """The set of each line as different numbers for different shingles, in order; none if the lines have too many characters for that."""
    data = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    if len(data) and data.max() + 1 >> BITS:
        some, data = np.unique(data, return_inverse=True)
        if len(some) >> BITS:
            return None
    data = data.astype(np.uint64) + np.uint64(1)  # no zero, so that a shorter line is no shingle
    n = max(0, len(data) - SHINGLE + 1)
    code = data[:n].copy()
    for k in range(1, SHINGLE):
        code <<= np.uint64(BITS)
        code |= data[k : k + n]
    out, lo = [], 0
    for size in map(len, lines):
        if size < SHINGLE:
            out.append(np.array([sum(x << BITS * k for k, x in enumerate(data[lo : lo + size].tolist()))], np.uint64))
        else:
            own = np.sort(code[lo : lo + size - SHINGLE + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        lo += size
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate((a, b)))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def similar(a: set[str] | np.ndarray, b: set[str] | np.ndarray, similarity: float) -> bool:
    both = (len(a & b) if isinstance(a, set) else _common(a, b)) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9 else 0
    return both >= similarity * (len(a) + len(b) - both) - 1e-9 and both > 0


def intersections(sets: list[set[str]] | list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many shingles the sets of ``rows`` share with each set, exactly.

    Shingles of one set alone are left out, and those that the same sets have are
    one column of a matrix, weighted by their number: near copies have few columns.
    """
    ids: dict[str, int] = {}
    if isinstance(sets[0], set):
        flat = np.concatenate([np.fromiter((ids.setdefault(x, len(ids)) for x in own), np.int64, len(own)) for own in sets])
    else:
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    n_ids = int(flat.max()) + 1
    owner = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    marks = np.random.default_rng(7).integers(0, 1 << 63, (2, len(sets)), np.uint64)
    who = np.zeros((2, n_ids), np.uint64)  # of 128 bits, that tell which sets have a shingle
    for k in (0, 1):
        np.add.at(who[k], flat, marks[k][owner])
    order = np.lexsort(who)
    new = np.concatenate(([True], (who[:, order[1:]] != who[:, order[:-1]]).any(0)))
    column = np.empty(n_ids, np.int64)
    column[order] = np.cumsum(new) - 1
    weight = np.bincount(column).astype(np.float32)
    first = np.zeros(n_ids, bool)
    first[order[new]] = True
    shared = first & (np.bincount(flat, minlength=n_ids) > 1)
    number = np.cumsum(shared) - 1
    use = shared[flat]
    at, owner, weight = number[flat[use]], owner[use], weight[column[shared]]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for lo in range(0, len(weight), COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, len(weight) - lo)), np.float32)
        part[owner[a:b], at[a:b] - lo] = 1
        out += (part[rows] * weight[lo : lo + COLUMNS]) @ part.T
    return out


def links_within(lines: list[str], similarity: float = SIMILARITY, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of lines whose shingle sets reach the Jaccard similarity, by exact intersections. Lines of one class are joined already."""
    n, sets = len(lines), _codes(lines) or [_sets(x) for x in lines]
    start = np.arange(n) if classes is None else np.unique(classes, return_inverse=True)[1]
    if n <= 8:
        label, links = start.tolist(), []
        for i, j in combinations(range(n), 2):
            if label[i] != label[j] and similar(sets[i], sets[j], similarity):
                links.append((i, j))
                label = [label[i] if x == label[j] else x for x in label]
        return links
    counts = np.fromiter(map(len, sets), np.int64, n)
    largest = np.bincount(start).argmax()
    asked = np.flatnonzero(start != largest) if (start == largest).sum() > 1 else np.arange(n)  # the others need not meet
    both = intersections(sets, asked)
    order = np.concatenate((asked, np.setdiff1d(np.arange(n), asked)))  # asked ones first: a pair is asked about by its first line
    label, links = start[order], []

    def near(i: int, apart: np.ndarray) -> np.ndarray:
        if i >= len(asked):
            return apart[:0]
        at = order[apart]
        share = both[i, at]
        return apart[(share > 0) & (share >= similarity * (counts[order[i]] + counts[at] - share) - 1e-9)]

    for x, y in forest(n, near, label):
        links.append((int(order[x]), int(order[y])))
    return links


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many lines each text has, null none, and all lines, by their places among distinct ones."""
    split = pc.split_pattern(texts, "\n")
    return np.diff(split.offsets.to_numpy()), split.flatten().dictionary_encode()


def _texts(lines: pa.Array) -> list[str]:
    return lines.to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist


def _distinct_lines(texts: pa.Array) -> dict[int, str]:
    return {_line_hash(x): x for x in _texts(_split(texts)[1].dictionary) if x and not x.isspace()}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of the first column, in arrays of bounded size."""
    for batch in batches:
        for part in slices(batch, 0, SLICE):
            yield part.column(0)


def _pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [_values(p.as_py()) for p in group.column("keys")]
    lines = [np.frombuffer(p.as_py(), np.int64) for p in group.column("lines")]
    return np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*lines, np.zeros(0, np.int64)])


def members(docs: DataFrame, parts: int) -> DataFrame:
    """(key, line): lines that share a band key with another line, for each such key; some rows come twice.

    A task that has more than ``SURE`` lines of a key knows that they share it and
    asks about one of them, so that no range gathers all lines of a common key.
    """
    edges = np.array([(1 << 64) * k // parts for k in range(1, parts)], np.uint64)

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(keys: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(keys, kind="stable")
            keys, lines = keys[order], lines[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            sure = np.repeat(sizes > SURE, sizes)
            known, known_lines = keys[sure], lines[sure]
            use = ~sure
            use[starts] = True
            keys, lines = keys[use], lines[use]
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            full = [(k, False, keys[a:b], lines[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            # what is known of common keys goes anywhere
            full += [(int(known_lines[a] % parts), True, known[a : a + HOT], known_lines[a : a + HOT]) for a in range(0, len(known), HOT)]
            columns = [pa.array([x[0] for x in full], pa.int32()), pa.array([x[1] for x in full]), pa.array([_planes(x[2]) for x in full], pa.binary()), pa.array([x[3].tobytes() for x in full], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["range", "sure", "keys", "lines"])

        seen: set[int] = set()
        held, size = [], 0
        for texts in _slices(batches):
            found = {h: x for h, x in _distinct_lines(texts).items() if h not in seen}
            seen.update(found)
            keys, owner = band_keys(list(found.values()))
            held.append((keys, np.fromiter(found, np.int64, len(found))[owner]))
            size += len(keys)
            if size > 3_000_000:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, size, seen = [], 0, set()
        if size:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    @released_group
    def shared(group: pa.Table) -> pa.Table:
        sure, group = group.filter(group.column("sure")), group.filter(pc.invert(group.column("sure")))
        known, known_lines = _pairs(sure)
        keys, lines = _pairs(group)
        order = np.argsort(keys, kind="stable")  # runs in order already
        keys, lines = keys[order], lines[order]
        same = keys[1:] == keys[:-1]
        use = (np.concatenate(([False], same)) | np.concatenate((same, [False])))[: len(keys)]
        keys, lines = keys[use], lines[use]
        order = np.lexsort((lines, keys))
        keys, lines = keys[order], lines[order]
        same = keys[1:] == keys[:-1]
        new = np.concatenate(([True], ~same | (lines[1:] != lines[:-1])))[: len(keys)]
        keys, lines = keys[new], lines[new]  # a line once under a key, then again only keys of several lines
        same = keys[1:] == keys[:-1]
        use = (np.concatenate(([False], same)) | np.concatenate((same, [False])))[: len(keys)]
        return pa.table({"key": np.concatenate((keys[use], known)).view(np.int64), "line": np.concatenate((lines[use], known_lines))})

    sent = docs.select("text").mapInArrow(send, "range int, sure boolean, keys binary, lines binary")
    return sent.groupBy("range").applyInArrow(shared, "key long, line long")


def _bitmap(lines: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bit of each line set; more lines than it has bits only let more through."""
    word = F.pmod(F.col("line"), F.lit(BITMAP))
    words = lines.groupBy((word / 32).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(line, {BITMAP}) % 32 as int)))").alias("bits"))
    out = np.zeros(BITMAP // 32, np.uint32)
    for batch in words.toArrow().to_batches():  # bounded by the bitmap
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return out


def _set(words: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Which lines have their bit in a bitmap."""
    at = lines % BITMAP
    return (words[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def sketches_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, kind, sketch) of the wanted lines, each once; a few others pass the bitmap and do no harm."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))  # of fixed size

    @released
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for texts in _slices(batches):
            found = _distinct_lines(texts)
            lines = np.fromiter(found, np.int64, len(found))
            use = _set(words, lines)
            lines = lines[use]
            for kind, (at, rows) in enumerate(sketches(list(compress(found.values(), use.tolist())))):
                ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(WIDTH)
                sketch = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
                yield pa.RecordBatch.from_arrays([pa.array(lines[at]), pa.array(np.full(len(at), kind, np.int64)), sketch], names=["line", "kind", "sketch"])

    return docs.select("text").mapInArrow(pick, "line long, kind long, sketch binary").distinct()  # a hash of whole rows, cheaper than a first value


def families(shared: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """(node, root) of lines that stay close by their sketches under some band key.

    The lines of a key are one group, unless they are over ``HOT``: then those that also have
    a piece of their sketches in common are, which separates no alike pair.
    """

    @released_group
    def close(group: pa.Table) -> pa.Table:
        keys, lines = group.column("key").to_numpy(), group.column("line").to_numpy()
        bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(lines), WIDTH)
        order = np.lexsort((lines, keys))  # links to the least line are alike under all keys of a family
        keys, lines, bits = keys[order], lines[order], bits[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        few = (sizes > 1) & (sizes <= SMALL)
        more: list[tuple[int, int]] = []
        for lo, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            more += [(lo + x, lo + y) for x, y in joined(bits[lo : lo + n])]
        at = np.concatenate([joined_small(bits, starts[few], sizes[few]), np.array(more, np.int64).reshape(-1, 2)])
        return pa.table({"a": lines[at[:, 0]], "b": lines[at[:, 1]]})

    rows = shared.join(marks, "line").where("kind + (key & 1L) != 1").select("key", "line", "sketch")  # an equal kind, said so that rows are sorted by one number
    hot = durable(shared.groupBy("key").count().where(F.col("count") > HOT).select("key"))
    if not hot.isEmpty():
        rows = durable(rows)
        pieces = [F.xxhash64("key", F.lit(k), F.substring("sketch", WIDTH * k // PIECES + 1, WIDTH * (k + 1) // PIECES - WIDTH * k // PIECES)) for k in range(PIECES)]
        split = _met(rows, hot, "key").withColumn("key", F.explode(F.array(*pieces)))
        rows = _met(rows, hot, "key", "left_anti").union(split)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(4 * parts)))
    return components(rows.groupBy("part").applyInArrow(close, "a long, b long"), reduce=False)


def _met(rows: DataFrame, known: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` (with a column line) joined with what is known of each key, in several parts of a key, so that a common one is not one task."""
    salted = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("part", F.pmod(F.xxhash64("line"), F.lit(SALTS).cast("long"))).join(salted, [key, "part"], how).drop("part")


def verified(family: DataFrame, texts: DataFrame, parts: int, similarity: float) -> DataFrame:
    """(a, b): links of similar lines that join each family's lines as all its similar pairs would.

    A family of up to ``BLOCK`` lines is one group. The lines of a larger one are
    compared, row by row, with about ``PIVOTS`` of them; the lines that this leaves
    out of the family's largest component are dealt into blocks, and each block
    meets the family's other blocks.
    """
    many = durable(family.groupBy("root").count().where(F.col("count") > BLOCK))
    family, zero = family.select(F.col("node").alias("line"), "root"), F.lit(0).cast("long")
    alone = lambda rows: rows.join(texts, "line").select("line", "text", "root", zero.alias("i"), zero.alias("j"), F.col("line").alias("class"))
    if many.isEmpty():
        return _checked(alone(family), parts, similarity)  # where a line that comes again counts once
    texts = durable(texts.distinct())
    family = durable(_met(family, many, "root", "left"))  # texts join what is left of numbers
    small = alone(family.where("count is null"))

    @released_group
    def near(group: pa.Table) -> pa.Table:
        is_pivot = group.column("pivot")
        pivots, some = group.filter(is_pivot), group.filter(pc.invert(is_pivot))
        known = [(line, _sets(text)) for line, text in zip(pivots.column("line").to_pylist(), pivots.column("text").to_pylist(), strict=True)]
        found = []
        for text in some.column("text"):
            own = _sets(text.as_py())
            found.append([p for p, theirs in known if similar(own, theirs, similarity)])
        return some.select(["line", "root"]).append_column("near", pa.array(found, pa.list_(pa.int64())))

    # a chunk of a family's lines meets copies of its pivots, about PIVOTS of them
    large = family.where("count is not null")
    chunks, none = F.ceil(F.col("count") / CHUNK), F.array().cast("array<struct<chunk: bigint, pivot: boolean>>")
    own = F.array(F.struct(F.pmod(F.xxhash64(F.lit("chunk"), "line"), chunks).alias("chunk"), F.lit(False).alias("pivot")))
    copies = F.transform(F.sequence(zero, chunks - 1), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("pivot")))
    is_pivot = F.pmod(F.xxhash64("line"), F.ceil(F.col("count") / PIVOTS)) == 0
    dealt = large.withColumn("to", F.concat(own, F.when(is_pivot, copies).otherwise(none))).join(texts, "line").select("line", "text", "root", F.explode("to").alias("to"))
    placed = durable(dealt.select("line", "text", "root", "to.*").groupBy("root", "chunk").applyInArrow(near, "line long, root long, near array<long>"))
    # pivots that a line is near to are of one class; there are few pairs of them
    pairs = placed.select("root", F.explode(F.transform("near", lambda p: F.struct(F.array_min("near").alias("a"), p.alias("b")))).alias("p"))
    counts = pairs.groupBy("root", "p").agg(F.count("*").alias("n")).groupBy("root").agg(F.collect_list(F.struct("p.a", "p.b", "n")).alias("pairs"))

    @F.pandas_udf("map<long,long>")
    def classes(rows: pd.Series) -> pd.Series:
        """Each pivot's class, the largest under the key of none."""
        out = []
        for some in rows:
            label = {p: p for x in some for p in (x["a"], x["b"])}
            for x in some:
                old, new = label[x["b"]], label[x["a"]]
                label = {p: new if c == old else c for p, c in label.items()}
            sizes: dict[int, int] = {}
            for x in some:
                if x["a"] == x["b"]:  # once for each line, under its least pivot
                    sizes[label[x["a"]]] = sizes.get(label[x["a"]], 0) + x["n"]
            out.append(label | {NONE: max(sizes, key=lambda c: (sizes[c], c))} if label else label)
        return pd.Series(out)

    known = counts.select("root", classes("pairs").alias("classes")).join(many, "root", "right")
    sized = durable(known.select("root", "classes", F.ceil(F.col("count") / BLOCK).alias("all")))
    own = F.try_element_at("classes", F.array_min("near"))
    placed = _met(placed, sized, "root").select("line", "root", "near", "all", F.coalesce(own, "line").alias("class"), F.coalesce(own == F.try_element_at("classes", F.lit(NONE)), F.lit(False)).alias("joined"))
    placed = durable(placed)
    links = placed.select("line", F.explode("near").alias("pivot")).where("line != pivot")
    blocks = durable(placed.where("not joined").groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    placed = _met(placed, blocks, "root")
    hashed = F.xxhash64("line")
    each = lambda n, i, j: F.transform(F.sequence(zero, F.col(n) - 1), lambda k: F.struct((k if i is None else i).alias("i"), (k if j is None else j).alias("j")))
    to_all = F.when(~F.col("joined"), each("all", F.pmod(hashed, F.col("blocks")), None)).otherwise(F.array().cast("array<struct<i: bigint, j: bigint>>"))
    to_apart = each("blocks", None, F.pmod(hashed, F.col("all")))
    met = placed.select("line", "root", "class", F.array_distinct(F.concat(to_all, to_apart)).alias("to")).join(texts, "line")
    met = met.select("line", "text", "root", F.explode("to").alias("to"), "class").select("line", "text", "root", "to.i", "to.j", "class")
    return _checked(small, parts, similarity).union(_checked(met, parts, similarity)).union(links.select("line", "pivot"))


def _checked(rows: DataFrame, parts: int, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of the similar lines within each cell (root, i, j)."""

    @released_group
    def check(group: pa.Table) -> pa.Table:
        group = group.sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending"), ("line", "ascending")])
        lines, cell = group.column("line").to_numpy(), np.stack([group.column(c).to_numpy() for c in ("root", "i", "j")])
        new = (cell[:, 1:] != cell[:, :-1]).any(0)
        once = np.concatenate(([True], new | (lines[1:] != lines[:-1])))
        group, lines = group.filter(pa.array(once)), lines[once]
        texts, classes = group.column("text").to_pylist(), group.column("class").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], new))[once])
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(lines)], strict=True):
            out += [(lo + x, lo + y) for x, y in links_within(texts[lo:hi], similarity, classes[lo:hi])]
        at = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": lines[at[:, 0]], "b": lines[at[:, 1]]})

    return rows.withColumn("part", F.pmod(F.xxhash64("root", "i", "j"), F.lit(4 * parts))).groupBy("part").applyInArrow(check, "a long, b long")


def relatives(docs: DataFrame) -> DataFrame:
    """(node, root): line hashes that may have near copies, and the family of each. ``docs`` has a column text."""
    parts = partitions(docs.sparkSession)
    shared = durable(members(docs, parts))
    return durable(families(shared, sketches_of(docs, shared), parts))


def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without their lines of the given numbers."""
    out = []
    for part in slices(pa.RecordBatch.from_arrays([texts, gone], names=["text", "gone"]), 0, SLICE):
        split, drop = pc.split_pattern(part.column(0), "\n"), part.column(1)
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
        starts, dropped = np.cumsum(counts) - counts, pc.fill_null(pc.list_value_length(drop), 0).to_numpy()
        kept = np.ones(counts.sum(), bool)
        kept[np.repeat(starts, dropped) + drop.flatten().to_numpy()] = False
        ends = np.append(0, np.cumsum(np.add.reduceat(np.append(kept, False), starts, dtype=np.int64) * (counts > 0)))
        rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), split.flatten().filter(pa.array(kept)))
        out.append(pc.if_else(part.column(0).is_null(), None, pc.binary_join(rest, "\n")))
    return pa.chunked_array(out, pa.string()).combine_chunks()


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with its text replaced by the kept lines, and ``n_lines``, ``n_removed``.

    Lines are what line feeds separate. Of each component of lines whose
    ``SHINGLE``-character shingles reach the Jaccard similarity, the line of the
    smallest (id, position) stays, null ids first. Lines of white space stay and
    are not compared. Rows that share an id are told apart by their texts; rows
    that share both keep and lose the same lines. A null text stays null with no
    lines. Existing columns of the two names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    family = relatives(plain)
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(family.select(F.col("node").alias("line"))))  # of fixed size

    @released
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                counts, found = _split(part.column(2))
                distinct, of = _texts(found.dictionary), found.indices.to_numpy()
                hashes = np.array([_line_hash(x) for x in distinct], np.int64)
                use = np.array([bool(x) and not x.isspace() for x in distinct], bool)[of]
                row = pa.array(np.repeat(np.arange(len(counts)), counts)[use])
                at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                of = of[use]
                told = np.full(len(of), -1, np.int32)  # a family's line has its text at its first place in the slice
                first = np.unique(of, return_index=True)[1]
                first = first[_set(words, hashes[of[first]])]
                told[first] = of[first]
                text = found.dictionary.take(pa.array(told, mask=told < 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(at[use]), pa.array(hashes[of]), text], names=["id", "row", "at", "node", "text"])

    row_key = F.xxhash64(F.lit("row"), F.col(id_col), F.col(text_col))
    place = durable(docs.select(F.col(id_col).alias("id"), row_key.alias("row"), F.col(text_col).alias("text")).mapInArrow(places, f"id {kind}, row long, at long, node long, text string"))
    texts = place.where("text is not null").select(F.col("node").alias("line"), "text")
    roots = components(verified(family, texts, partitions(docs.sparkSession), similarity), reduce=False)
    # only lines with several places, or in a component, can go; of each component the first place stays
    often = place.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    labels = often.join(roots, "node", "full").select("node", F.coalesce("root", "node").alias("label"))
    found = durable(place.join(labels, "node").select("label", "id", "row", "at"))
    firsts = durable(found.groupBy("label").agg(F.min(F.struct("id", "row", "at")).alias("keep")))
    gone = found.join(firsts, "label").where("row != keep.row or at != keep.at")  # of written tables, so that Spark can split a common label
    key, lost, out = fresh(docs, "_row"), fresh(docs, "_gone"), fresh(docs, "_kept")
    gone = gone.groupBy("row").agg(F.collect_set("at").alias(lost)).withColumnRenamed("row", key)
    joined = docs.withColumn(key, row_key).join(gone.hint("shuffle_hash"), key, "left")  # texts are not sorted for it

    keep = F.arrow_udf(without, "string")

    text, hit = F.col(text_col), F.col(lost).isNotNull()
    done = joined.withColumn(out, keep(F.when(hit, text), F.col(lost)))
    count = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    removed = F.when(hit, F.size(lost)).otherwise(0).cast("long")
    return done.select(*[F.when(hit, F.col(out)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns], count.alias("n_lines"), removed.alias("n_removed"))
