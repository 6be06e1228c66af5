"""Full-text search over whole documents, through an index that the query builds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fulltext
from .registry import query, table

#: Searches that the queries run, in web-search syntax.
SIMPLE = ['"general public license"', "email -the", '"of the" thing or idiot', "-the -de -la", '"rights reserved" or "general public" -email', "zzzz or the and"]
ENGLISH = ["licenses", '"general public licensing"', "reserving rights", "the and of", "kubernetes or emailed -copyrights", '"all rights reserved"']

_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM w)"""
_CASES = [
    ("contains(s, ' general public license ')", ["general", "public", "license"]),
    ("contains(s, ' email ') AND NOT contains(s, ' the ')", ["email"]),
    ("contains(s, ' of the ') AND contains(s, ' thing ') OR contains(s, ' idiot ')", ["of", "the", "thing", "idiot"]),
    ("NOT contains(s, ' the ') AND NOT contains(s, ' de ') AND NOT contains(s, ' la ')", []),
    ("contains(s, ' rights reserved ') OR contains(s, ' general public ') AND NOT contains(s, ' email ')", ["rights", "reserved", "general", "public"]),
    ("contains(s, ' zzzz ') OR contains(s, ' the ') AND contains(s, ' and ')", ["zzzz", "the", "and"]),
]


def _ranked(number: int, condition: str, terms: list[str]) -> str:
    """SQL of one search: what it finds, with the sum over its terms of the share that each has in the rank."""
    names = ", ".join(f"'{t}'" for t in terms)
    part = "ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))"
    score = f"coalesce((SELECT sum({part}) FROM (SELECT u.term, df, len(list_filter(w, lambda x: x = u.term)) AS tf FROM (SELECT unnest([{names}]) AS term) u JOIN df ON df.term = u.term)), 0)" if terms else "0.0"
    return f"SELECT {number} AS search, doc_id, round(CAST({score} AS DOUBLE), 6) AS rank FROM t, n WHERE {condition}"


def found(index: fulltext.Index, searches: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [fulltext.search(index, q).select(F.lit(i).alias("search"), F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank")) for i, q in enumerate(searches)])


@query(f"""WITH {_WORDS}, n AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM w), df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM w) GROUP BY 1)
{" UNION ALL ".join(_ranked(i, c, terms) for i, (c, terms) in enumerate(_CASES))}""")
def full_text_search(spark, sf):
    """Words as they are, quotations, `or` and `-`, ranked."""
    return found(fulltext.index(table(spark, sf, "documents"), "doc_id", "text", "simple"), SIMPLE)


@query()
def full_text_search_english(spark, sf):
    """Stems and stop words; held against brute force in tests."""
    return found(fulltext.index(table(spark, sf, "documents"), "doc_id", "text"), ENGLISH)


@query(rf"""WITH {_WORDS} SELECT o_orderkey FROM orders o WHERE o_orderpriority ILIKE '%urgent%' OR EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_name ILIKE '%9%urgent%')
OR EXISTS (SELECT 1 FROM t WHERE t.doc_id = o.o_orderkey AND contains(s, ' general public license '))""")
def search_jobs_full_text(spark, sf):
    """Jobs whose address, owner's name or transcript matches: the transcript through the index, by its key."""
    jobs, users = table(spark, sf, "orders"), table(spark, sf, "customer")
    index = fulltext.index(table(spark, sf, "documents"), "doc_id", "text", "simple")
    texts = fulltext.search(index, '"general public license"').select(F.col("key").alias("o_orderkey"))
    named = jobs.join(users.where(F.ilike("c_name", F.lit("%9%urgent%"))).select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")
    urgent = jobs.where(F.ilike("o_orderpriority", F.lit("%urgent%"))).select("o_orderkey")
    hits = jobs.join(texts.unionByName(named).distinct(), "o_orderkey", "left_semi").select("o_orderkey")
    return urgent.unionByName(hits).distinct()
