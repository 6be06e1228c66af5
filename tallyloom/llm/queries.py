"""The queries that apply the operators of this subpackage, with production parameters, to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokenizer file; a parameter of every operator that reads one.
TOKENIZER = "byte_bpe_50k.json"
#: Model file of op13.
PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find, train

    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import classes

    return classes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find

    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import find

    return find(table(spark, sf_dir, "documents")).drop("cuts")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    return mine(table(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file(PIECES))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_toxicity": op5_toxicity,
    "op6_html_text": op6_html_text,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_licenses": op10_licenses,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sentencepiece": op13_sentencepiece,
}

_WORDS = """w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN len(w) >= 5 THEN len(w) - 4 WHEN len(w) > 0 THEN 1 ELSE 0 END AS n FROM w),
p AS (SELECT doc_id, unnest(range(0, n)) AS p, w FROM n), s AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM p)"""
_REACH = """c AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT a, a FROM l UNION SELECT b, b FROM l), r AS (SELECT a, b FROM c UNION SELECT r.a, c.b FROM r JOIN c ON c.a = r.b)"""

#: CRC-32 of the decimal conv_id: eight shifts for each of its bytes, under the reflected polynomial.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": f"""WITH RECURSIVE {_WORDS}, d AS (SELECT DISTINCT doc_id, s FROM s), z AS (SELECT doc_id, count(*) AS z FROM d GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM d x JOIN d y ON x.s = y.s AND x.doc_id > y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * o >= 80 * (x.z + y.z - o)), {_REACH}
SELECT w.doc_id, coalesce(z, 0) AS n_shingles, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id) AS component_id FROM w LEFT JOIN z ON z.doc_id = w.doc_id""",
    "op7_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id > y.vec_id AND list_cosine_similarity(x.x, y.x) >= 0.95), {_REACH}, k AS (SELECT a, count(*) FILTER (WHERE a <> b) AS n FROM c GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, m AS component_id, e.vec_id = m AS kept FROM (SELECT vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id) AS m FROM embeddings) e LEFT JOIN k ON k.a = e.vec_id""",
    "op8_decontamination": f"""WITH {_WORDS}, bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
bn AS (SELECT item_id, w, len(w) AS k, CASE WHEN len(w) >= 5 THEN len(w) - 4 ELSE 1 END AS n FROM bw WHERE len(w) > 0), bp AS (SELECT item_id, k, unnest(range(0, n)) AS q, w FROM bn),
b AS (SELECT item_id, k, q, array_to_string(w[q + 1:q + 5], ' ') AS s FROM bp), i AS (SELECT count(*) AS i FROM bn), wt AS (SELECT s, ln(1 + (SELECT i FROM i) / count(DISTINCT item_id)) AS wt FROM b GROUP BY s),
t AS (SELECT item_id, sum(wt) AS total FROM (SELECT DISTINCT item_id, s FROM b) JOIN wt USING (s) GROUP BY 1),
h AS (SELECT DISTINCT s.doc_id, b.item_id, least(k, len(n.w)) AS k, greatest(0, least(p - q, len(n.w) - k)) AS start FROM s JOIN b ON b.s = s.s JOIN n ON n.doc_id = s.doc_id),
g AS (SELECT h.doc_id, h.item_id, h.k, start, sum(wt) AS held FROM (SELECT DISTINCT h.doc_id, h.item_id, h.k, start, s.s FROM h JOIN s ON s.doc_id = h.doc_id AND p BETWEEN start AND start + greatest(0, k - 5)
JOIN b ON b.item_id = h.item_id AND b.s = s.s) h JOIN wt USING (s) GROUP BY ALL),
x AS (SELECT *, held / total AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(held / total, 9) DESC, start) AS n FROM g JOIN t USING (item_id) WHERE held / total >= 0.8 - 1e-12)
SELECT doc_id, item_id, start AS first_word, k AS n_words, round(similarity, 6) AS similarity FROM x WHERE n = 1""",
    "op11_prefix_trie": f"""WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, n, id, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND n <= h UNION ALL SELECT conv_id, n, id, words FROM c JOIN t USING (conv_id) WHERE n > h),
s AS (SELECT conv_id, coalesce(list(id ORDER BY n) FILTER (WHERE id IS NOT NULL), []) AS ids, coalesce(list(words ORDER BY n) FILTER (WHERE id IS NOT NULL), []) AS words FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
d AS (SELECT *, unnest(range(0, len(ids) + 1)) AS depth FROM s), p AS (SELECT conv_id, depth, array_to_string(ids[1:depth], '') AS k, array_to_string(ids[1:depth - 1], '') AS up, words[depth] AS words, depth = len(ids) AS last FROM d),
g AS (SELECT k, CASE WHEN depth > 0 THEN up END AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY ALL),
n AS (SELECT g.*, (SELECT count(*) FROM g AS x WHERE x.up = g.k) AS n_children FROM g)
SELECT n.conv_id, n.depth, (SELECT x.conv_id FROM g AS x WHERE x.k = n.up) AS parent_conv_id, n.n_convs, n.n_children, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.words) AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN n AS m ON starts_with(m.k, n.k) GROUP BY n.k, n.up, n.conv_id, n.depth, n.n_convs, n.n_children, n.ends_sha256""",
    "op12_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
a AS (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
}
