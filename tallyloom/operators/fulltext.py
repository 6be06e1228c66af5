"""Full-text search: an inverted index with positions as a table by word, web-search syntax, and a rank.

index() writes one row for each word of each text, with the word's positions, ordered by word: a search reads the buckets of its own
words only, and of these the row groups whose range holds them. What a row group or task holds is a range of (word, text), so
a word of every text is many tasks. Words are runs of letters and digits, in lower case; the configuration `english` takes
stems and leaves out stop words (which keep their positions), `simple` takes words as they are.

Search syntax: words stand for themselves and all must occur; "quoted words" must follow each other; `or` between two operands means
either; a leading `-` means not. `or` binds weakest. A word that is several runs (e.g. hyphenated) is a quotation. Operands
without any indexed word are left out; a query that has none left finds nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import STOP_WORDS, stem
from ..sources.tables import shared_folder

BUCKETS = 64
#: The bucket of the rows that tell each text's number of words.
TEXTS = -1
#: Postings are made of so many words at once, and those of one text more.
BLOCK_WORDS = 500_000
#: Saturation and length normalisation of the rank (BM25).
K1, B = 1.2, 0.75

_RUN = re.compile(r"[^\W_]+")
_OPERAND = re.compile(r'(-?)(?:"([^"]*)"?|(\S+))')


@lru_cache(maxsize=200_000)
def lexeme(word: str, config: str) -> str | None:
    """What a lower-case word is indexed as; None for a stop word."""
    return word if config == "simple" else None if word in STOP_WORDS else stem(word)


@dataclass(frozen=True)
class Index:
    """Tables of an index: postings (bucket, term, key, positions, n) and texts (key, n); n is the number of words of the text."""

    postings: DataFrame
    texts: DataFrame
    config: str

    @cached_property
    def total(self) -> Row:
        """Number of texts and mean number of their words, counted once for all searches."""
        return self.texts.agg(F.count("*").alias("texts"), F.avg("n").alias("mean")).first()


@dataclass
class Operand:
    """Terms with their distances from the first; more than one is a quotation."""

    terms: list[tuple[int, str]]
    negated: bool


@dataclass
class Search:
    """Branches of which one must hold; in a branch, all operands must."""

    branches: list[list[Operand]] = field(default_factory=list)

    def terms(self, negated: bool | None = None) -> list[str]:
        return sorted({t for b in self.branches for o in b if negated is None or o.negated == negated for _, t in o.terms})


def parsed(query: str, config: str = "english") -> Search:
    """Web-search syntax to branches of operands."""
    branches: list[list[Operand]] = [[]]
    found = list(_OPERAND.finditer(query))
    for i, m in enumerate(found):
        minus, quoted, word = m.groups()
        if word is not None and word.lower() == "or" and not minus and 0 < i < len(found) - 1:
            branches.append([])
            continue
        terms = [(at, lexeme(w, config)) for at, w in enumerate(_RUN.findall((quoted if word is None else word).lower()))]
        terms = [(at, t) for at, t in terms if t is not None]
        if terms:
            branches[-1].append(Operand([(at - terms[0][0], t) for at, t in terms], minus == "-"))
    return Search([b for b in branches if b])


def _block(keys: pa.Array, counts: list[int], words: list[str], config: str) -> Iterator[pa.RecordBatch]:
    """Postings of some texts' words (counts: how many each text has), and for each text a row without a term."""
    n, coded = np.array(counts, np.int32), pa.array(words, pa.string()).dictionary_encode()
    terms: dict[str, int] = {}
    held = (lexeme(w, config) for w in coded.dictionary.to_pylist())  # each word's lexeme is sought once
    number = np.array([-1 if t is None else terms.setdefault(t, len(terms)) for t in held], np.int64)
    term = number[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
    group = term * len(n) + np.repeat(np.arange(len(n)), n)
    at = (np.arange(len(words)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)).astype(np.int32)
    kept = np.flatnonzero(term >= 0)
    kept = kept[np.argsort(group[kept], kind="stable")]
    group = group[kept]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    row = pa.array(group[first] % len(n))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(group)).astype(np.int32)), pa.array(at[kept]))
    spelled = pa.array(list(terms), pa.string()).take(pa.array(group[first] // len(n)))
    yield pa.RecordBatch.from_arrays([spelled, keys.take(row), places, pa.array(n).take(row)], ["term", "key", "positions", "n"])
    yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()), keys, pa.nulls(len(n), places.type), pa.array(n)], ["term", "key", "positions", "n"])


def _rows(docs: DataFrame, key: str, text: str, config: str) -> DataFrame:
    """Postings of all texts, and a row without a term or positions for each text."""

    def run(batches):
        for batch in batches:
            low, counts, words = 0, [], []
            for i, t in enumerate(batch.column(1)):
                found = _RUN.findall((t.as_py() or "").lower())
                words += found
                counts.append(len(found))
                if len(words) >= BLOCK_WORDS:
                    yield from _block(batch.column(0)[low : i + 1], counts, words, config)
                    low, counts, words = i + 1, [], []
            if counts:
                yield from _block(batch.column(0)[low:], counts, words, config)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "term string, key long, positions array<int>, n int")


def postings(docs: DataFrame, key: str, text: str, config: str = "english") -> DataFrame:
    """term, key, positions (from 0) and n (words of the text) for each term of each text; null texts have none. Keys are longs."""
    return _rows(docs, key, text, config).where("term IS NOT NULL")


def index(docs: DataFrame, key: str, text: str, config: str = "english", path: str | None = None) -> Index:
    """Writes the index of docs to a folder (a new shared one by default) and opens it. Keys should be unique.

    Texts are read once. A bucket's rows are dealt by a hash of the key too, as ranges would need the postings twice, first for a sample.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "fulltext")
    shares = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    bucket = F.when(F.col("term").isNull(), TEXTS).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    rows = _rows(docs, key, text, config).withColumn("bucket", bucket)
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(shares))).sortWithinPartitions("bucket", "term", "key")
    rows.write.partitionBy("bucket").parquet(f"{path}/postings")
    return opened(spark, path, config)


def opened(spark: SparkSession, path: str, config: str = "english") -> Index:
    rows = spark.read.schema("term string, key long, positions array<int>, n int, bucket int").parquet(f"{path}/postings")
    return Index(rows.where(F.col("bucket") != TEXTS), rows.where(F.col("bucket") == TEXTS).select("key", "n"), config)


def of_terms(index: Index, terms: list[str]) -> DataFrame:
    """The postings of terms: their buckets are a partition filter, the terms a pushed one."""
    spark = index.postings.sparkSession
    if not terms:
        return index.postings.where("false")
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    return index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def _holds(operand: Operand) -> Column:
    """Whether the positions by term of a text satisfy an operand; null positions mean that the term is not there."""
    places = lambda t: F.try_element_at("places", F.lit(t))
    back = lambda column, at: F.transform(column, lambda x: x - at)
    (_, first), *rest = operand.terms
    begins = places(first)
    for at, term in rest:
        begins = F.array_intersect(begins, back(places(term), at))
    found = F.coalesce(F.size(begins), F.lit(-1)) > 0
    return ~found if operand.negated else found


def search(index: Index, query: str) -> DataFrame:
    """key and rank of the texts that a query in web-search syntax finds.

    The rank is BM25 over the terms that are not negated. Only postings of the query's terms are read; texts that a purely negated
    branch finds come from the table of texts, with rank 0.
    """
    wanted = parsed(query, index.config)
    if not wanted.branches:
        return index.texts.select("key", F.lit(0.0).alias("rank")).where("false")
    rows = of_terms(index, wanted.terms())
    total = index.total
    held = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term of the query
    # as many rows for a text as the query has terms
    texts = rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"), F.first("n").alias("n"))
    if any(all(o.negated for o in branch) for branch in wanted.branches):
        texts = index.texts.select("key", F.col("n").alias("_n")).join(texts, "key", "left").withColumn("n", F.coalesce("n", "_n"))
    matches, rank = F.lit(False), F.lit(0.0)
    for branch in wanted.branches:
        all_hold = F.lit(True)
        for operand in branch:
            all_hold = all_hold & _holds(operand)
        matches = matches | all_hold
    for term in wanted.terms(negated=False):
        idf = math.log(1 + (total["texts"] - held.get(term, 0) + 0.5) / (held.get(term, 0) + 0.5))
        tf = F.coalesce(F.size(F.try_element_at("places", F.lit(term))), F.lit(0)).cast("double")
        tf = F.greatest(tf, F.lit(0.0))
        rank = rank + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(total["mean"] or 1.0)))
    return texts.where(matches).select("key", F.when(F.size("places") > 0, rank).otherwise(0.0).alias("rank"))
