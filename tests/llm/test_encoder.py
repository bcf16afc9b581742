"""The packing encoder: whole slices of a batch at once, with merge tables made before."""

import itertools
import pickle
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridstride.llm import common, packing
from gridstride.llm.bpe import Merges
from gridstride.llm.queries import tokenizer_file

SPEC = tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("memo", [packing.MEMO, 3])
def test_encoder_equals_the_library(memo, monkeypatch):
    """Ids and ends are the library's, with the end id behind each text, also where the memo is cleared and where texts are left to the library."""
    monkeypatch.setattr(packing, "MEMO", memo)
    r = random.Random(5)
    letters = "abcdeéßÄŉž'’.,-1234567890€\t\n  " + "中İ́\xa0"
    texts = ["", None, " ", "\n\n", "  two  spaces ", "don't 'stop ''s 's's ,'s I'LL we'veve 'd", "x1y22²½ ...,'", "a" * 700, "é" * 151 + " ok", "<|endoftext|> b", "İstanbul", "éa", "a\x1cb\x0bc"]
    texts += ["".join(r.choices(letters, k=r.randrange(60))) for _ in range(600)] + ["".join(r.choices(letters[:-4], k=r.randrange(60))) for _ in range(600)]
    encoder = packing.Encoder(SPEC, pickle.loads(pickle.dumps(Merges(SPEC))), 1)
    library = Tokenizer.from_str(SPEC)
    for some in (texts, texts[:40], [None], [""]):
        ids, ends = encoder.encode(pa.array(some, pa.string()))
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in some]
        assert ends.tolist() == list(itertools.accumulate(map(len, want)))
        starts = [0, *ends[:-1].tolist()]
        for t, w, a, b in zip(some, want, starts, ends.tolist(), strict=True):
            assert ids[a:b].tolist() == w, t


def test_slices_are_bounded_by_bytes():
    """Long texts are not encoded by hundreds at once."""
    texts = [None, "", *["x" * 200_000] * 60, "y" * (5 * common.SLICE), None, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    parts = list(common.slices(batch, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [sorted(len(t or "") for t in p.column(1).to_pylist()) for p in parts]
    assert all(sum(s[:-1]) <= common.SLICE for s in sizes)  # and one text more
    assert list(common.slices(batch.slice(0, 0), 1)) == []
