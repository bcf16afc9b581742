"""The pipeline on a fixture whose outcome at each stage is known, and against stage-by-stage brute force."""

import random

from tokenizers import Tokenizer

import corpus_pipeline
from gridstride.llm.queries import tokenizer_file


def fixture():
    r = random.Random(12)
    words = {"xx": ["kamiro", "tuka", "romi", "karo", "mitu"], "yy": ["schein", "ungder", "einsch", "derung", "undein"]}
    line = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice("abcdefgh") + r.choice(words[lang]) for _ in range(n))
    item = " ".join(f"{r.choice(words['xx'])}{i}" for i in range(25))
    docs = [(i, "\n".join(line("xx" if i % 2 else "yy", 30) for _ in range(4)), "xx" if i % 2 else "yy") for i in range(40)]
    shared = line("xx", 25)
    docs += [(100, docs[3][1], "xx"), (101, f"{shared}\n{line('xx', 40)}", "xx"), (102, f"{shared.replace('a', 'a', 1)}!\n{line('xx', 40)}", "xx")]
    near = [line("xx", 12) for _ in range(12)]
    docs += [(110, "\n".join(near), "xx"), (111, " ".join(near), "xx")]
    docs += [(120, f"{line('xx', 20)} {item} {line('xx', 20)}", "xx"), (121, "12 34 .. 56", "xx"), (122, None, None), (123, "", "xx")]
    return [(i, t, lang, "src", len(t) if t else None) for i, t, lang in docs], item


def test_stages(spark, tmp_path):
    rows, item = fixture()
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never there at all in any document of this table")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in kept[name].values())
    everything = {r[0] for r in rows}
    assert set(kept["language_id"]) == everything - {121, 122, 123}
    assert set(kept["line_dedup"]) == set(kept["language_id"]) - {100}  # a copy loses all its lines
    text = {i: r.text for i, r in kept["line_dedup"].items()}
    before = {r[0]: r[1] for r in rows}
    assert text[101] == before[101] and text[102] == before[102].split("\n")[1] and text[3] == before[3]
    assert set(kept["near_dedup"]) == set(kept["line_dedup"]) - {111}  # the same words with other white space
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {120}
    library = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    want = {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in kept["decontamination"].items()}
    got: dict[int, int] = {}
    for r in kept["packing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    whole = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in kept["packing"]}


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without an id, and rows that share one, pass all stages as rows of their own; rows that are wholly the same give one document."""
    folder, r = str(tmp_path), random.Random(3)
    words = {"xx": ["kamiro", "tuka", "romi", "karo", "mitu"], "yy": ["schein", "ungder", "einsch", "derung", "undein"]}
    text = lambda lang: "\n".join(" ".join(r.choice(words[lang]) + r.choice("abcdefgh") + r.choice(words[lang]) for _ in range(30)) for _ in range(3))
    rows = [(i, text("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy", "s", 9) for i in range(40)]
    rows += [(None, text("xx"), "xx", None, None), (None, text("yy"), None, None, None), (7, text("xx"), "xx", "s", 9), (7, rows[7][1], "xx", "s", 9), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    library = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids) + 1
    want: dict = {}
    for i, t, *_ in [x for x in rows[:43] if x[1]]:
        want[i] = want.get(i, 0) + size(t)
    got: dict = {}
    for p in corpus_pipeline.run(spark, folder).collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
