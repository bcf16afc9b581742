"""Queries of the corpus operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstride.llm import bytepairs, decontam, html, langid, lines, packing, runs, simhash, spelling, substring, token_counts, topk, toxicity
from gridstride.llm.common import held_out, table


def tokenizer_file(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return toxicity.toxicity(docs, net).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(~held_out("doc_id")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"), with_text=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 of the kept lines joined by line feeds."""
    done = lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and test item: doc_id, item_id, distance."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    done = bytepairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    done = bytepairs.decode(done, ranks, public_tokenizers.PATTERN)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def planted_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the words of each text; where crc32(doc_id) ends in 0, all from word a on repeat the p words there."""
    rows = docs.select("doc_id", F.coalesce(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"), F.array().cast("array<string>")).alias("w"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when((F.col("h") % 10 == 0) & (n > 0), (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    # copies of the p words, then the first of them that fill the rest
    part = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(part, F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("w")).otherwise(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), n)).alias("words"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted_words(table(spark, sf_dir, "documents")))
    # the greatest length, then the smallest start and period, as the least of a struct
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines_, ""), 256).alias("runs_sha256"), F.sha2(F.array_join("kept", " "), 256).alias("collapsed_sha256"),
    )


def altered_runs(docs: DataFrame) -> DataFrame:
    """(word) of each run of at least 6 letters, A-Z lower-cased; where 199 divides crc32(``doc_id:run``), without its code point crc32 % length."""
    run = F.explode(F.expr("regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{6,}', 0)"))
    rows = docs.select("doc_id", run.alias("run")).withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return rows.select(F.when(F.col("h") % 199 == 0, less).otherwise(F.col("run")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of ``documents``; a null doc_id counts as empty text in the checksum."""
    return spelling.variants(spelling.word_counts(altered_runs(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_repeated_passages, op4_token_counts, op5_packing, op6_main_text, op7_top_products, op8_line_dedup, op9_simhash, op10_decontamination, op11_bytepairs, op12_periodic_runs, op13_spelling_variants)}

ORACLE_SQL: dict[str, str] = {
    "op3_repeated_passages": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS words FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY words) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM repeated),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs) ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r)
""",
    "op7_top_products": """
WITH parts AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
bad AS (SELECT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM bad)
),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scores)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(list_transform(string_split(id, ''), lambda c: unicode(c)), lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END)) AS b FROM counted),
hashed AS (SELECT run, n, length(run) AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x::BIGINT) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc),
altered AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.l || h.r
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.l || h.r
),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN (FROM best WHERE k = 1) USING (word)),
follow(word, root, next) AS (SELECT word, word, form FROM formed UNION ALL SELECT f.word, g.word, g.form FROM follow f JOIN formed g ON g.word = f.next)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (FROM follow WHERE next IS NULL) USING (word)
""",
}
