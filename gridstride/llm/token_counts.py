"""Token counts of whole texts by the whole-token shortcut (operator 4).

Most pre-tokens of a text are vocabulary strings that encode as one token. Which
strings do is proved once, on the driver, by running every vocabulary string
through the merges; the result is bounded by the vocabulary. Tasks then count
such pre-tokens as 1 and merge only the others.

A text is cut at line feeds and single spaces first, because a byte-level
pre-token never reaches over those when no other white space stands beside them.
Fields repeat much, so a bounded memo per worker holds their counts. Texts where
a cut would touch other white space go through the pre-token pattern whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstride.llm.bpe import LONGEST, Merges

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 300_000
#: A field whose edge is white space cannot be counted alone.
NOT_ALONE = -(1 << 50)


def whole_tokens(spec: str) -> list[str]:
    """Vocabulary strings, as text, that the merges turn into their one token."""
    merges = Merges(spec)
    back = {s: b for b, s in enumerate(merges.symbols)}
    names = [(n, i) for n, i in merges.vocab.items() if all(c in back for c in n)]
    raw = [bytes(back[c] for c in n) for n, _ in names]
    ids, sizes = merges.encode(raw)
    at, out = 0, []
    for (name, number), data, size in zip(names, raw, sizes, strict=True):
        if size == 1 and ids[at] == number:
            try:
                out.append(data.decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a pre-token by itself
        at += size
    return out


class Counter:
    def __init__(self, spec: str, whole: list[str]):
        self.spec, self.merges, self.find = spec, Merges(spec), regex.compile(PATTERN).findall
        self.specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.specials))).split if self.specials else lambda t: [t]
        self.whole = dict.fromkeys(whole, 1)
        self.pieces: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.library = None

    def _merge(self, pieces: set[str]) -> None:
        """Memo the counts of pre-tokens that are no whole token."""
        rest = [(p, p.encode()) for p in pieces]
        short = [x for x in rest if len(x[1]) <= LONGEST]
        if short:
            _, sizes = self.merges.encode([b for _, b in short])
            self.pieces.update(zip((p for p, _ in short), sizes.tolist(), strict=True))
        for p, b in rest:
            if len(b) > LONGEST:
                if self.library is None:
                    from tokenizers import Tokenizer

                    self.library = Tokenizer.from_str(self.spec)
                self.pieces[p] = len(self.library.encode(p, add_special_tokens=False).ids)

    def _count(self, found: list[list[str]]) -> list[int]:
        whole = self.whole
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        self._merge({p for ps in found for p in ps if p not in whole and p not in self.pieces})
        return [sum([whole[p] if p in whole else self.pieces[p] for p in ps]) for ps in found]

    def _learn(self, memo: dict[str, int], fields: set[str], before: str) -> None:
        fields = list(fields)
        counts = self._count([self.find(before + f) for f in fields])
        for f, n in zip(fields, counts, strict=True):
            memo[f] = NOT_ALONE if not f or f[0].isspace() or f[-1].isspace() else n

    def count(self, texts: list[str]) -> list[int]:
        segments, owner, totals = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            parts = self.split(t) if any(s in t for s in self.specials) else [t]
            totals[i] = len(parts) - 1
            for p in parts:
                if p:
                    segments.append([line.split(" ") for line in p.split("\n")])
                    owner.append((i, p))
        for memo in (self.first, self.later):
            if len(memo) > MEMO:
                memo.clear()
        firsts = {line[0] for s in segments for line in s}
        laters: set[str] = set()
        for s in segments:
            for line in s:
                laters.update(line[1:])
        self._learn(self.first, firsts - self.first.keys(), "")
        self._learn(self.later, laters - self.later.keys(), " ")
        one, more, slow = self.first, self.later, []
        for (i, p), s in zip(owner, segments, strict=True):
            n = len(s) - 1
            for line in s:
                n += one[line[0]] + sum(map(more.__getitem__, line[1:]))
            if n < 0:
                slow.append((i, p))
            else:
                totals[i] += n
        for (i, _), n in zip(slow, self._count([self.find(p) for _, p in slow]), strict=True):
            totals[i] += n
        return totals


def token_counts(docs: DataFrame, spec: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; null text counts as empty.

    ``spec`` is the content of a byte-level tokenizer's JSON. Repeated rows give
    repeated results; other columns are not read; an empty table gives no rows.
    """
    whole = whole_tokens(spec)
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = pa.array(counter.count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), n], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
