"""Full-text search: a stored inverted index with positions, conjunctive ranked matches and phrases.

Words are lower-case runs of letters and digits, numbered by their place in the document. Stop words are left out (they
keep their places), the others are reduced to their stems and folded to plain letters; queries go through the same steps.
A posting is (token, doc_id, tf, positions): positions are sorted, and the file format stores them as differences.

* ``fts_match``: documents that hold all terms of a query, scored by Σ tf · ln(N / df).
* ``fts_phrase``: documents that hold the terms of a query at the same distances as the query: the positions of each term
  are shifted by its place in the query and intersected.
"""

from __future__ import annotations

import pkgutil
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import accent_table, concat_search_text
from tessera.functions.stemmer import STEMMERS, composed
from tessera.operators.joins import broadcast_checked
from tessera.operators.layout import dealt, written_once

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# The token under which the index counts a document: its posting holds the number of its indexed words.
EVERY_DOCUMENT = ""
# Bytes of text that a task indexes at a time, and of the texts whose usual words are stemmed beforehand.
TEXT_BYTES = 8 << 20
USUAL_BYTES = 32 << 20
# Differences of neighbouring numbers take the place of whole positions in the files.
POSITION_FORMAT = {"parquet.writer.version": "v2", "parquet.enable.dictionary#positions.list.element": "false"}


@lru_cache(maxsize=8)
def stop_words(language: str = "portuguese") -> tuple[str, ...]:
    """The stop-word list of ``language`` (Spark's public default list, kept as package data so that no jar has to
    be found), accent folded."""
    raw = pkgutil.get_data("tessera.data", f"stopwords_{language}.txt")
    if not raw:
        raise ValueError(f"no stop-word list for {language}")

    def fold(w):
        return "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn").lower()
    return tuple(sorted({fold(w) for w in raw.decode("utf-8").split()}))


def tokens(col: Column | str) -> Column:
    """The words of a text column in order (array), lower-case, with their accents."""
    text = composed(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda x: x != "")


def _folded(token: Column) -> Column:
    """A token without accents. Tokens are lower-case and hold no combining marks, so a table look-up is all it takes."""
    return F.translate(token, *accent_table())


def with_token(df: DataFrame, language: str = "portuguese", stems: bool = True) -> DataFrame:
    """``df`` (with ``word``) and what the word is filed under as ``token``: its stem without accents; words with digits
    stay whole, as do all words of a language without a stemmer."""
    if not stems or language not in STEMMERS:
        return df.withColumn("token", _folded(F.col("word")))
    stem = STEMMERS[language](F.col("word"))
    return df.withColumn("token", _folded(F.when(F.col("word").rlike(r"\p{N}"), F.col("word")).otherwise(stem)))


def _indexed(token: Column, language: str) -> Column:
    return ~_folded(token).isin(list(stop_words(language)))


def token_bucket(col: Column, buckets: int) -> Column:
    """Stable hash bucket of a token (the stored index is partitioned by it)."""
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def _usual_stems(doc: DataFrame, text_bytes: int, language: str) -> DataFrame:
    """(word, usual, kept): the tokens of words that come up again in a small share of the texts, and whether they are
    indexed at all, to be sent to every task. It only saves time: a word that is not among them is looked at and stemmed
    where it stands."""
    share = min(1.0, USUAL_BYTES / max(1, text_bytes))
    some = doc.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    words = some.select(F.explode(tokens("text")).alias("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word")
    return with_token(often, language).select("word", F.col("token").alias("usual"),
                                              _indexed(F.col("word"), language).alias("kept"))


def _sorted_fast(token: str, doc_id: str) -> Column:
    """A number that differs for nearly all pairs of token and document, equal tokens side by side. As the first key of a
    grouping that sorts, it settles nearly all comparisons (the other keys settle the rest), and the sorted rows, token by
    token, take little room."""
    return F.shiftleft(F.hash(token).cast("bigint"), 32).bitwiseOR(F.hash(doc_id).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def _postings(df: DataFrame, id_col: str, text_cols: list[str], language: str, stems: bool, positions: bool,
              marked: bool = False) -> DataFrame:
    """(token, doc_id, tf[, positions]) and, if ``marked``, under ``EVERY_DOCUMENT`` one posting per document with an indexed
    word. Rows meet once, by document, in partitions of about ``TEXT_BYTES`` of text, so that what a task sorts or counts
    does not grow with the table. (A filter on the tokens above would be moved below the stemming and stem every word
    twice.)"""
    text = df.select(F.col(id_col).alias("doc_id"), concat_search_text(*text_cols).alias("text"))
    text_bytes = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    doc = dealt(text, "doc_id", text_bytes, TEXT_BYTES).select("doc_id", tokens("text").alias("words"))
    mark = F.when(F.exists("words", lambda w: _indexed(w, language)), F.array(F.lit(EVERY_DOCUMENT))).otherwise(
        F.array().cast("array<string>"))
    every = F.concat("words", mark) if marked else F.col("words")
    words, indexed = doc.select("doc_id", F.posexplode(every).alias("place", "word")), _indexed(F.col("word"), language)
    if stems and language in STEMMERS:
        words = words.join(F.broadcast(_usual_stems(text, text_bytes, language)), on="word", how="left")
        words = with_token(words.where(F.coalesce("kept", indexed)), language).withColumn("token", F.coalesce("usual", "token"))
    else:
        words = with_token(words.where(indexed), language, stems)
    if not positions:
        return words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf")).select("token", "doc_id", "tf")
    return (words.groupBy(_sorted_fast("token", "doc_id").alias("_at"), "doc_id", "token")
            .agg(F.sort_array(F.collect_list(F.col("place") + 1)).alias("positions"))
            .select("token", "doc_id", F.size("positions").cast("bigint").alias("tf"), "positions"))


def fts_index(df: DataFrame, id_col: str, text_cols: list[str], language: str = "portuguese", stems: bool = True,
              positions: bool = False) -> DataFrame:
    """(token, doc_id, tf) and, if asked for, the sorted places of the token's words (from 1, stop words counted).
    ``stems=False`` files whole words."""
    return _postings(df, id_col, text_cols, language, stems, positions)


@dataclass(frozen=True)
class StoredIndex:
    """A text index in use: postings partitioned by token bucket, the document frequency per token (same buckets), and
    the number of indexed documents."""

    spark: SparkSession
    path: str
    buckets: int
    language: str = "portuguese"
    stems: bool = True

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def n_docs(self) -> int:
        every = self.terms.where((F.col("bucket") == token_bucket(F.lit(EVERY_DOCUMENT), self.buckets))
                                 & (F.col("token") == EVERY_DOCUMENT)).select("df").first()
        return every[0] if every else 0


def store_index(df: DataFrame, id_col: str, text_cols: list[str], path: str, buckets: int, language: str = "portuguese",
                stems: bool = True) -> StoredIndex:
    """Build and write the index (full refresh). Postings are dealt by token bucket in partitions of about equal size: a
    bucket with a common token is split over as many tasks and files as its size asks for. Terms and documents are counted
    in one pass over the tokens of the stored postings (nothing else of them is read)."""
    spark = df.sparkSession
    postings = _postings(df, id_col, text_cols, language, stems, positions=True, marked=True)
    (postings.withColumn("bucket", token_bucket(F.col("token"), buckets)).hint("rebalance", F.col("bucket"))
     .write.options(**POSITION_FORMAT).mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"))
    terms = spark.read.parquet(f"{path}/postings").groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df"))
    (terms.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms"))
    return StoredIndex(spark, path, buckets, language, stems)


# ---- queries ------------------------------------------------------------------------------------------------------

def query_terms(query_df: DataFrame, language: str = "portuguese", stems: bool = True) -> DataFrame:
    """(query_id, token, places): the distinct search tokens of each query with their places in it (from 0)."""
    words = query_df.select("query_id", F.posexplode(tokens("text")).alias("place", "word")).where(
        _indexed(F.col("word"), language))
    return (with_token(words, language, stems).groupBy("query_id", "token")
            .agg(F.sort_array(F.collect_list("place")).alias("places")))


def _asked(index: DataFrame | StoredIndex, query_df: DataFrame, language: str, n_docs: DataFrame | int | None,
           columns: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The terms of the queries that can match (query_id, token, places, df, _n terms of the query, _idf), the postings of
    those terms with ``columns``, and what the two are joined on. Of a stored index only the buckets of the asked tokens
    are read, once; the terms and their postings are written, since several steps read them."""
    if isinstance(index, StoredIndex):
        on = ["bucket", "token"]
        q = query_terms(query_df, index.language, index.stems).withColumn("bucket", token_bucket(F.col("token"), index.buckets))
        q = written_once(q, "asked")
        # at most as many values as there are buckets
        buckets = F.col("bucket").isin([r["bucket"] for r in q.select("bucket").distinct().collect()])
        dfreq, postings, total = index.terms.where(buckets), index.postings.where(buckets), F.lit(index.n_docs)
    else:
        on, q = ["token"], query_terms(query_df, language)
        # only the postings of query tokens count
        postings = index.join(broadcast_checked(q.select("token").distinct()), on=on, how="left_semi")
        dfreq = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        total = index.select("doc_id").distinct().agg(F.count(F.lit(1))).scalar() if n_docs is None else None
    if n_docs is not None:
        total = F.lit(n_docs) if isinstance(n_docs, int) else n_docs.agg(F.count(F.lit(1))).scalar()
    # per query its terms with their frequencies; a query with a term that no document holds has no match
    own = Window.partitionBy("query_id")
    found = dfreq.join(broadcast_checked(q.select(*on).distinct()), on=on, how="left_semi")
    terms = (q.join(found, on=on, how="left").withColumn("_n", F.count(F.lit(1)).over(own))
             .withColumn("_known", F.count("df").over(own)).where(F.col("_known") == F.col("_n"))
             .select("query_id", *on, "places", "df", "_n", F.log(total / F.col("df")).alias("_idf")))
    if isinstance(index, StoredIndex):
        terms = written_once(terms, "asked-terms")
        postings = written_once(postings.join(broadcast_checked(terms.select(*on).distinct()), on=on, how="left_semi")
                            .select(*on, "doc_id", *columns), "asked-postings")
    return terms, postings, on


def _looked_up(terms: DataFrame, postings: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """The postings of every term of a query in the documents of its rarest term: only those can hold all of them, so the
    work is min(df) × terms, not Σ df."""
    rare = terms.groupBy("query_id").agg(F.min_by(F.struct(*on), F.struct("df", "token")).alias("_t")) \
        .select("query_id", *[F.col(f"_t.{c}").alias(c) for c in on])
    cand = postings.join(broadcast_checked(rare), on=on).select("query_id", "doc_id")
    need = cand.join(broadcast_checked(terms.drop("df")), on="query_id")
    return need.join(postings.select(*on, "doc_id", *columns), on=[*on, "doc_id"], how="inner")


def fts_match(index: DataFrame | StoredIndex, query_df: DataFrame, k: int = 10, language: str = "portuguese",
              n_docs: DataFrame | int | None = None) -> DataFrame:
    """Top-k documents per query holding every query term, scored by Σ tf · ln(N / df) (rounded to 6 digits), ties by
    doc_id. ``query_df`` = (query_id, text). ``index``: postings (token, doc_id, tf) of stems, or a stored index, of which
    only the buckets of the query tokens are read and whose stored counts give N and df. ``n_docs`` replaces N."""
    terms, postings, on = _asked(index, query_df, language, n_docs, ["tf"])
    per_doc = _looked_up(terms, postings, on, ["tf"]).groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("_m"), F.max("_n").alias("_n"), F.sum(F.col("tf") * F.col("_idf")).alias("_s"))
    full = per_doc.where(F.col("_m") == F.col("_n"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return (full.select("query_id", "doc_id", F.round("_s", 6).alias("score"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint")))


def _shifted(positions: Column, place: Column) -> Column:
    return F.transform(positions, lambda p: p - place)


def fts_phrase(index: DataFrame | StoredIndex, query_df: DataFrame, language: str = "portuguese") -> DataFrame:
    """(query_id, doc_id, hits, first_place): the documents in which the query's words stand as they do in the query (a
    stop word of the query stands for any one word), how often, and where the first such place begins (words counted from
    1). ``index``: postings with positions, or a stored index."""
    terms, postings, on = _asked(index, query_df, language, 0, ["positions"])
    # where the phrase would begin for each posting: its positions shifted by each of the term's places in the query
    begins = F.aggregate(F.slice(F.col("places"), F.lit(2), F.size("places")), _shifted(F.col("positions"), F.col("places")[0]),
                         lambda acc, place: F.array_intersect(acc, _shifted(F.col("positions"), place)))
    per_term = _looked_up(terms, postings, on, ["positions"]).select("query_id", "doc_id", "_n", begins.alias("begins"))
    per_doc = (per_term.where(F.size("begins") > 0).groupBy("query_id", "doc_id", "_n")
               .agg(F.collect_list("begins").alias("all")).where(F.size("all") == F.col("_n")))
    both = F.aggregate(F.slice(F.col("all"), F.lit(2), F.size("all")), F.col("all")[0], F.array_intersect)
    return (per_doc.select("query_id", "doc_id", both.alias("begins")).where(F.size("begins") > 0)
            .select("query_id", "doc_id", F.size("begins").cast("bigint").alias("hits"),
                    F.array_min("begins").cast("bigint").alias("first_place")))
