"""Queries of the corpus operators over the supplied tables, with SQL of the same meaning where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The url rules (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query(
    "op2_url_verdicts",
    r"""
WITH rules(given, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (SELECT page_id, rowid AS r,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM (SELECT *, row_number() OVER () AS rowid FROM pages)),
fits AS (SELECT r, rule_host || rule_path AS rule, given,
    row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(given, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)
""",
)
def op2_url_verdicts(spark, sf):
    from .urls import rule_table, url_verdicts

    return url_verdicts(table(spark, sf, "pages"), rule_table(spark, URL_RULES))


@query(
    "op7_exact_dedup",
    r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
  translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS content FROM documents),
w AS (SELECT content, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM d JOIN w USING (content)
""",
)
def op7_exact_dedup(spark, sf):
    from .exact import exact_groups

    return exact_groups(table(spark, sf, "documents"))


@query("op10_secret_scan")
def op10_secret_scan(spark, sf):
    from .secrets import find_secrets, joined, train_markov, training_samples

    docs = table(spark, sf, "documents")
    found = find_secrets(docs, train_markov(training_samples(docs)))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "extra")).alias("spans"),
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_planes")
def op1_token_planes(spark, sf):
    from tagsight.plans.lineage import scratch_path

    from .planes import read_documents, write_token_files

    out = scratch_path(spark, "token-ids")
    write_token_files(table(spark, sf, "documents"), out, tokenizer_path("byte_bpe_50k.json"))
    return read_documents(spark, out)


@query("op5_packing")
def op5_packing(spark, sf):
    from .packing import pack

    return pack(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


def fold(col: str = "doc_id"):
    """Remainder that tells held-out rows (0) from the others."""
    return F.crc32(F.col(col).cast("string")) % 5


def toxic_model(spark, docs, sf):
    from .toxic import train

    return train(docs, table(spark, sf, "labels").where(fold() != 0))


@query("op3_toxicity")
def op3_toxicity(spark, sf):
    from .toxic import score

    docs = table(spark, sf, "documents")
    found = score(docs, toxic_model(spark, docs, sf))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


@query("op9_benchmark_tiling")
def op9_benchmark_tiling(spark, sf):
    from .tiling import contamination

    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf):
    from .debruijn import drop_repeats

    kept = drop_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf):
    from .suffixes import drop_repeats

    kept = drop_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_near_dedup")
def op6_near_dedup(spark, sf):
    from .minmax import near_groups

    return near_groups(table(spark, sf, "documents"), width=2)


@query(
    "op11_phrases",
    r"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
words AS (SELECT piece, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces),
runs AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, [w1] AS words, count(*) AS a FROM runs GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
parts AS MATERIALIZED (SELECT lang, words, a, k, list_slice(words, 1, k) AS first, list_slice(words, k + 1, len(words)) AS rest
  FROM f, (VALUES (1), (2), (3)) s(k) WHERE k < len(words)),
cuts AS (SELECT c.lang, c.words, c.a, k, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * c.a // (l.a + r.a) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.words ORDER BY 2000000::HUGEINT * c.a // (l.a + r.a), k) AS place
  FROM parts c JOIN f l ON l.lang = c.lang AND l.words = c.first JOIN f r ON r.lang = c.lang AND r.words = c.rest),
longest AS (SELECT lang, list_slice(words, i, i + k - 1) AS words, max(a) AS longer
  FROM (SELECT lang, words, a, k, unnest(range(1, len(words) - k + 2)) AS i FROM f, (VALUES (2), (3)) s(k) WHERE len(words) > k) GROUP BY ALL),
best AS (SELECT c.* FROM cuts c LEFT JOIN longest i ON i.lang = c.lang AND i.words = c.words
  WHERE place = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * c.a)),
ranked AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
)
def op11_phrases(spark, sf):
    from .phrases import collocations

    return collocations(table(spark, sf, "documents"))


@query("op12_crosstok")
def op12_crosstok(spark, sf):
    from .crosstok import alignment_report

    return alignment_report(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query(
    "op13_near_vectors",
    """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id)
""",
)
def op13_near_vectors(spark, sf):
    from .quantised import near_vectors

    return near_vectors(table(spark, sf, "embeddings"))
