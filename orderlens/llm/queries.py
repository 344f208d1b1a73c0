"""The registered queries of this folder: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import (
    graph_index,
    merkle_manifest,
    packing,
    phrase_mining,
    piece_sampling,
    quality_classifier,
    quality_rules,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
    window_packing,
)

Runner = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Pages carry no fetch day and there is no list, so both follow from the page:
# every seventh page changes a list by its host, its first path segment or its address.
FETCHED = "date_add(DATE'2024-01-01', CAST(page_id * 7919 % 365 AS INT))"
CHANGED = "date_add(DATE'2024-01-01', CAST(page_id * 31 % 365 AS INT))"


def captures_and_changes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    captures = pages.select("page_id", "url", F.expr(FETCHED).alias("fetched"))
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    first = F.substring_index(path, "/", 1)
    key = (
        F.when(F.expr("page_id % 3 = 0"), F.concat(F.lit("host "), host))
        .when(F.expr("page_id % 3 = 1"), F.concat(F.lit("path "), host, F.lit("/"), first))
        .otherwise(F.concat(F.lit("address "), host, F.lit("/"), path))
    )
    changes = pages.where("page_id % 7 = 0").select(
        F.when(F.expr("page_id % 2 = 0"), "malware").otherwise("spam").alias("list"),
        key.alias("key"),
        F.when(F.expr("page_id % 5 < 2"), url_filter.ADD).otherwise(url_filter.REMOVE).alias("action"),
        F.expr(CHANGED).alias("day"),
    )
    return captures, changes


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    captures, changes = captures_and_changes(_table(spark, folder, "pages"))
    return url_filter.filter_urls(captures, changes).select(
        "row.page_id", F.col("row.fetched").cast("string").alias("fetched"), "host", "n_entries", "lists", "kept"
    )


URL_FILTERS_SQL = r"""
WITH parsed AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 365 AS INT) AS DATE) AS fetched,
         regexp_replace(regexp_replace(regexp_replace(
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)),
           '^.*@', ''), '(:[0-9]*)?$', ''), '\.$', '') AS site,
         list_filter(string_split(
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 2), '/'), lambda s: s <> '') AS segments
  FROM pages
), addressed AS (
  SELECT page_id, fetched, CASE WHEN site <> '' THEN site END AS host, segments,
         array_to_string(segments, '/') AS path, string_split(site, '.') AS labels
  FROM parsed
), changes AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'malware' ELSE 'spam' END AS list,
         CASE WHEN page_id % 3 = 0 THEN 'host ' || host
              WHEN page_id % 3 = 1 THEN 'path ' || host || '/' || coalesce(segments[1], '')
              ELSE 'address ' || host || '/' || path END AS key,
         max(CASE WHEN page_id % 5 < 2 THEN 1 ELSE 0 END) AS listed,
         CAST(DATE '2024-01-01' + CAST(page_id * 31 % 365 AS INT) AS DATE) AS day
  FROM addressed WHERE page_id % 7 = 0 AND host IS NOT NULL GROUP BY ALL
), intervals AS (
  SELECT list, key, listed, day AS valid_from, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS valid_to
  FROM changes
), probes AS (
  SELECT page_id, fetched, 'host ' || array_to_string(labels[i:], '.') AS key
  FROM (SELECT *, unnest(range(1, greatest(2, len(labels)))) AS i FROM addressed WHERE host IS NOT NULL)
  UNION ALL
  SELECT page_id, fetched, 'path ' || host || '/' || array_to_string(segments[:i], '/')
  FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM addressed WHERE host IS NOT NULL)
  UNION ALL
  SELECT page_id, fetched, 'address ' || host || '/' || path FROM addressed WHERE host IS NOT NULL
), found AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM probes JOIN intervals USING (key)
  WHERE listed = 1 AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
  GROUP BY page_id
)
SELECT page_id, CAST(fetched AS VARCHAR) AS fetched, host, coalesce(n, 0) AS n_entries,
       coalesce(lists, '') AS lists, n IS NULL AS kept
FROM addressed LEFT JOIN found USING (page_id)
"""


def _tokenizer(name: str) -> str:
    """A vocabulary file of the public tokenizers, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_sentencepiece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return piece_sampling.round_trip(_table(spark, folder, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeated_words(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return quality_classifier.quality_scores(docs, labels)


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph_index.nearest(_table(spark, folder, "embeddings"), F.expr("vec_id % 50 = 0"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeated_bytes(_table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.sha2("kept", 256).alias("kept_sha256")
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", kept)


def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_mining.collocations(_table(spark, folder, "documents"))


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM pieces CROSS JOIN (VALUES (1), (2), (3), (4), (5)) sizes(k))
  GROUP BY ALL
), candidates AS (
  SELECT c.lang, k, phrase, f AS a, n
  FROM counts c JOIN (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang) USING (lang)
  WHERE k > 1 AND f >= 100
), cuts AS (
  SELECT lang, k, phrase, a, n, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.k, a, h.f AS l, r.f AS r, n,
         1000::HUGEINT * a * n // (h.f::HUGEINT * r.f) AS score, j
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = head JOIN counts r ON r.lang = c.lang AND r.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM scored s
WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.lang = s.lang AND c.k > s.k AND 100 * c.a >= 100 * s.a
                  AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))
QUALIFY rank <= 2000
"""


def op12_window_packing(spark: SparkSession, folder: str) -> DataFrame:
    return window_packing.pack_windows(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"))


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.manifest(
        _table(spark, folder, "documents"),
        tampered={"text": F.translate("text", CAPITALS, CAPITALS.lower())},
        tampered_if=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
    )


# The CRC-32 of the key's digits: the reflected polynomial, bit by bit.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))"""


def _merkle_sql(fanout: int = 16, group_levels: int = 7, top_levels: int = 5) -> str:
    """Trees level by level; a level of one node is passed on as it is. Enough levels for 16 ** 7 leaves."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]

    def leaf(replaced: dict[str, str]) -> str:
        parts = []
        for name in fields:
            value = f"CAST({replaced.get(name, name)} AS VARCHAR)"
            parts.append(f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')")
        return f"sha256({' || '.join(parts)})"

    letters = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    steps = [
        f"""leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf({})} AS leaf,
               {leaf({"text": letters})} AS altered FROM documents))""",
        "g0 AS (SELECT tree, i, leaf AS d FROM leaves)",
    ]

    def levels(name: str, count: int) -> None:
        for n in range(1, count + 1):
            steps.append(f"""{name}{n} AS (
  SELECT tree, i // {fanout} AS i,
         CASE WHEN any_value(nodes) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM {name}{n - 1}) GROUP BY tree, i // {fanout})""")
            steps.append(f"""{name}_path{n} AS (
  SELECT a.tree, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
         coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS behind,
         any_value(b.nodes) > 1 AS hashed
  FROM {name}{n - 1} a JOIN (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM {name}{n - 1}) b
    ON a.tree = b.tree AND a.i // {fanout} = b.i // {fanout} GROUP BY a.tree, a.i)""")

    levels("g", group_levels)
    steps.append(f"""t0 AS (SELECT '' AS tree, tree AS part, row_number() OVER (ORDER BY tree) - 1 AS i, d
  FROM g{group_levels})""")
    levels("t", top_levels)
    steps.append(f"""f0 AS (
  SELECT l.*, t0.i AS top, t0.d AS subroot, '' AS proof,
         CASE WHEN crc32_of % 5 = 0 THEN altered ELSE leaf END AS folded
  FROM (SELECT *, {CRC32} AS crc32_of FROM leaves) l JOIN t0 ON t0.part = l.tree)""")
    last = 0
    for name, count, tree, at in (("g", group_levels, "f.tree", "f.i"), ("t", top_levels, "''", "f.top")):
        for n in range(1, count + 1):
            steps.append(f"""f{last + 1} AS (
  SELECT f.* REPLACE (proof || before || behind AS proof,
                      CASE WHEN hashed THEN sha256(before || folded || behind) ELSE folded END AS folded)
  FROM f{last} f JOIN {name}_path{n} p ON p.tree = {tree} AND p.i = {at} // {fanout ** (n - 1)})""")
            last += 1
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = t.d AS verified
FROM f{last} CROSS JOIN t{top_levels} t"""


QUERIES: dict[str, Runner] = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sentencepiece_sampling": op3_sentencepiece_sampling,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_window_packing": op12_window_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_url_filters": URL_FILTERS_SQL,
    "op11_phrase_mining": PHRASES_SQL,
    "op13_merkle_manifest": _merkle_sql(),
}
