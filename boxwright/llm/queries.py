"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm import bpe, centroids, decontaminate, language_model, pii, prefix_trie, quality, secrets, simhash, suffix_dedup, token_counts, token_files, tokens, url_filter
from boxwright.session import scratch_path

#: The public tokenizer that queries use; a name or a path.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return tokens.tokenizer_json(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), spec())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, spec(), end_id=2)
    return token_files.read_digests(spark, path)


#: Stands for a secret that a real run gets from its own store.
PII_KEY = "example key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, count="n_values").select("doc_id", "n_values", "text")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.by_limit(token_counts.histogram(table(spark, sf_dir, "documents"), spec()))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


#: Hosts and paths with their verdicts; the longest that fits counts.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Pages under an address that a feed links are copies of it: their hosts and paths are listed.
FEED = r"\?([^#]*&)?utm_source="


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_and_path(F.col("url"))
    feeds = pages.filter(F.col("url").rlike(FEED)).select(host.alias("host"), path.alias("path")).filter("host <> '' and path <> ''")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(pages, rules, feeds).select("page_id", "host", "path", "rule", "verdict")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_quality, op3_bpe, op4_decontaminate, op5_token_files, op6_pii, op7_language_model, op8_secrets, op9_token_counts, op10_suffix_dedup, op11_prefix_trie, op12_url_filter, op13_centroids)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("{}", _LOWER)
_PLAIN = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
sizes AS (SELECT DISTINCT n FROM grams),
windows AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, w.n, k, item FROM windows w JOIN grams USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS w FROM documents),
grams AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k:k + 4]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS place FROM grams WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, source, text, line, len(regexp_extract_all(line, {_PLAIN})) AS words, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm
 FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_PLAIN})),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY 1),
frequent AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS docs FROM lines GROUP BY 1, 2) JOIN hosts USING (source)
 WHERE docs > {quality.MIN_DOCS} AND (docs > host_docs * {quality.MAX_SHARE} OR docs > {quality.MAX_DOCS})),
gone AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS n FROM lines JOIN frequent USING (source, norm) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {quality.MIN_WORDS} OR n_words - n_removed_words < n_words * {quality.MIN_LEFT})) AS kept FROM m"""


TRIE_SQL = """
WITH t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS same, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'same': same, 'size': size} ORDER BY turn NULLS FIRST, same) AS t FROM t GROUP BY 1),
hashed AS (SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295, [ascii(x) for x in string_split(CAST(conv_id AS VARCHAR), '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 9 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
begins AS (SELECT conv_id, d, len(t) = d AS ends, md5(array_to_string([x.same for x in t[1:d]], ',')) AS node, md5(array_to_string([x.same for x in t[1:d - 1]], ',')) AS parent, t[d].size AS size FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(size), 0) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM begins GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
sized AS (SELECT n.*, coalesce(k.n, 0) AS children FROM nodes n LEFT JOIN kids k USING (d, node)),
under AS (SELECT a.d, a.node, sum(CAST(s.children = 0 AS INT)) AS leaves, sum((s.n - 1) * s.size) AS saved FROM sized s JOIN begins a ON a.conv_id = s.conv_id AND a.d <= s.d GROUP BY 1, 2)
SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, s.n AS n_convs, s.children AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM sized s JOIN under u USING (d, node) LEFT JOIN nodes p ON s.d > 0 AND p.d = s.d - 1 AND p.node = s.parent"""

_ADDRESS = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"

URL_SQL = f"""
WITH p AS (SELECT page_id, url, translate({_ADDRESS.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_ADDRESS.format(2)} AS path FROM pages),
rules AS (SELECT * FROM (VALUES {', '.join(map(str, URL_RULES))}) r(h, b, v)),
fits AS (SELECT page_id, h || b AS rule, v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || b) DESC, length(h) DESC) = 1),
feeds AS (SELECT DISTINCT host AS h, path AS b FROM p WHERE regexp_matches(url, '{FEED}') AND host <> '' AND path <> ''),
under AS (SELECT DISTINCT page_id FROM p JOIN feeds ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b))
SELECT p.page_id, host, path, rule, coalesce(v, CASE WHEN u.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM p LEFT JOIN fits USING (page_id) LEFT JOIN under u ON u.page_id = p.page_id"""


def _kmeans_sql() -> str:
    """Rounds as one table after the other."""
    near = "SELECT vec_id, v, j, d FROM (SELECT vec_id, v, j, list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, 65)]) AS d FROM kept, {c}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1"
    mean = "SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY k) AS m FROM (SELECT j, k, sum(v[k]) AS s, count(*) AS n FROM {a}, range(1, 65) t(k) GROUP BY j, k) GROUP BY j"
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h LIMIT 8))",
    ]
    for r in range(centroids.ROUNDS):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(CAST(m AS BIGINT[]), c) AS c FROM c{r} LEFT JOIN ({mean.format(a=f'a{r}')}) USING (j))")
    last = f"c{centroids.ROUNDS}"
    return "WITH " + ",\n".join(parts) + f""",
a AS ({near.format(c=last)})
SELECT vec_id, CAST(j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN {last} USING (j)"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; tests hold the others against brute force."""
    return {"op2_quality": QUALITY_SQL, "op4_decontaminate": DECONTAMINATE_SQL, "op11_prefix_trie": TRIE_SQL, "op12_url_filter": URL_SQL, "op13_centroids": _kmeans_sql()}
