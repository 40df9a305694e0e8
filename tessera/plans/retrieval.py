"""Search queries: token index and term match over documents (benchmark passages as queries), exact and
approximate cosine neighbours (label centroids as queries), dimension truncation, embedding passes, fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import stemmer as P
from tessera.operators import search as S
from tessera.plans.registry import query
from tessera.plans.standins import Tables
from tessera.session import scratch_path
from tessera.sources.folders import Folder

K = 10
# The vector of a text in the embedding queries: how often each of these letters occurs.
EMBED_LETTERS = "etaoinsr"


def _sw_sql() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in S.stop_words("portuguese"))


def _tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _ending(suffixes: list[str]) -> str:
    """A pattern that finds the longest of ``suffixes`` at the end of a word."""
    return f"(?:{'|'.join(suffixes)})$"


def _cut_sql(word: str, suffixes: list[str], floor: str) -> str:
    found = f"length(regexp_extract({word}, '{_ending(suffixes)}'))"
    return f"case when length({word}) - {found} >= {floor} then left({word}, length({word}) - {found}) else {word} end"


def _stems_sql(words: str) -> str:
    """(word, token) for the distinct words of ``words`` (word): the stemmer's steps, one query per step."""
    every = P.DELETED + [s for g in P.REPLACED.values() for s in g] + P.ADVERB + P.MANNER + P.QUALITY + P.KIND + P.AGENT

    def among(suffixes: list[str]) -> str:
        return "s in (" + ", ".join(f"'{x}'" for x in suffixes) + ")"
    replaced = " ".join(f"when {among(g)} and st >= p2 then b || '{r}'" for r, g in P.REPLACED.items())
    standard = (
        f"case when s = '' then w when {among(P.DELETED)} and st >= p2 then b {replaced} when {among(P.ADVERB)} and st >= p1 "
        f"then case when b like '%iv' then case when st - 2 >= p2 then {_cut_sql('left(b, st - 2)', ['at'], 'p2')} else b end "
        f"else {_cut_sql('b', ['os', 'ic', 'ad'], 'p2')} end when {among(P.MANNER)} and st >= p2 then "
        f"{_cut_sql('b', ['ante', 'avel', 'ível'], 'p2')} when {among(P.QUALITY)} and st >= p2 then "
        f"{_cut_sql('b', ['abil', 'ic', 'iv'], 'p2')} when {among(P.KIND)} and st >= p2 then {_cut_sql('b', ['at'], 'p2')} when "
        f"{among(P.AGENT)} and st >= pv and b like '%e' then b || 'ir' else w end")
    steps = [
        "select *, replace(replace(word, 'ã', 'a~'), 'õ', 'o~') as w",
        f"select *, regexp_extract(w, '{P.AFTER_VOWEL}', 1) as r1, length(w) - length(regexp_extract(w, '{P.AFTER_START}', 1)) "
        f"as pv, regexp_extract(w, '{_ending(every)}') as s",
        f"select *, length(w) - length(r1) as p1, length(w) - length(regexp_extract(r1, '{P.AFTER_VOWEL}', 1)) as p2, left(w, "
        "length(w) - length(s)) as b, length(w) - length(s) as st",
        f"select *, {standard} as one",
        f"select *, case when one <> w then one else left(w, length(w) - length(regexp_extract(substr(w, pv + 1), "
        f"'{_ending(P.VERBS)}'))) end as two",
        "select *, case when two = w then " + _cut_sql("two", P.RESIDUAL, "pv") + " when two like '%ci' and length(two) - 1 >= "
        "pv then left(two, length(two) - 1) else two end as three",
        "select *, case when not regexp_matches(three, '[eéê]$') then regexp_replace(three, 'ç$', 'c') when length(three) - 1 < "
        "pv then three else left(three, length(three) - 1) end as four",
        "select *, case when regexp_matches(three, '(gu|ci)[eéê]$') and length(three) - 2 >= pv then left(four, length(four) - "
        "1) else four end as five",
        "select word, strip_accents(case when regexp_matches(word, '\\p{N}') then word else replace(replace(five, 'a~', 'ã'), "
        "'o~', 'õ') end) as token"]
    sql = f"(select distinct word from {words})"
    for i, step in enumerate(steps):
        sql = f"({step} from {sql} s{i})"
    return sql


def _words_sql(table: str, key: str, text: str = "text") -> str:
    """(key, word, place from 1) of the words that are indexed."""
    return (f"(select {key}, word, place from (select {key}, unnest(ws) as word, generate_subscripts(ws, 1) as place from "
            f"(select {key}, {_tokens_sql(text)} as ws from {table}) a) b where strip_accents(word) not in ({_sw_sql()}))")


def _placed_sql(name: str, table: str, key: str) -> str:
    """CTEs: ``name`` has (key, token, place) of the stems."""
    return (f"{name}_words as {_words_sql(table, key)}, {name} as (select {key}, token, place from {name}_words join "
            f"{_stems_sql(name + '_words')} st using (word))")


def _index_sql() -> str:
    return f"with idx as (with {_placed_sql('d', 'documents', 'doc_id')} select token, doc_id, count(*) as tf from d group by all)"


def _word_index_sql() -> str:
    return (f"with idx as (select strip_accents(word) as token, doc_id, count(*) as tf from {_words_sql('documents', 'doc_id')} "
            "w group by all)")


@query("fts_index", bench=True, oracle=lambda: _index_sql() + " select * from idx")
def q_fts_index(spark, sf):
    return S.fts_index(Tables(spark, sf).documents, "doc_id", ["text"])


@query("fts_index_words", oracle=lambda: _word_index_sql() + " select * from idx")
def q_fts_index_words(spark, sf):
    """Whole words: no stemming."""
    return S.fts_index(Tables(spark, sf).documents, "doc_id", ["text"], stems=False)


@query("fts_positions", oracle=lambda: (
    f"with {_placed_sql('d', 'documents', 'doc_id')} select token, doc_id, count(*) as tf, list(cast(place as integer) order "
    "by place) as positions from d group by token, doc_id"))
def q_fts_positions(spark, sf):
    return S.fts_index(Tables(spark, sf).documents, "doc_id", ["text"], positions=True)


def _ranked_sql(index: str, terms: str) -> str:
    return (f"{index}, q as (select distinct item_id as query_id, token from {terms} t), "
            "n as (select query_id, count(*) as nt from q group by query_id), dfq as (select token, count(*) as df "
            "from idx group by token), nd as (select count(distinct doc_id) as nn from idx), "
            "h as (select q.query_id, idx.doc_id, count(*) as m, sum(idx.tf * ln(nd.nn / dfq.df)) as s from q join "
            "idx on q.token = idx.token join dfq on dfq.token = q.token, nd group by q.query_id, idx.doc_id), "
            "f as (select h.query_id, doc_id, round(s, 6) as score from h join n on h.query_id = n.query_id where "
            "m = nt) select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id "
            f"order by score desc, doc_id) as rank from f) r where rank <= {K}")


def _match_sql() -> str:
    return _ranked_sql(_index_sql(), f"(with {_placed_sql('b', 'benchmark', 'item_id')} select * from b)")


def _word_match_sql() -> str:
    words = f"(select item_id, strip_accents(word) as token from {_words_sql('benchmark', 'item_id')} w)"
    return _ranked_sql(_word_index_sql(), words)


# Stored indexes of this application, by their source: a table is indexed when it is loaded and asked many times.
_INDEXES: dict[tuple, S.StoredIndex] = {}


def stored_index(spark, sf: str, stems: bool = True) -> S.StoredIndex:
    """The index of ``documents`` as a stored table in use: written once per application and state of the table (its
    files, their sizes and times), partitioned by token bucket, under the shared checkpoint folder (bucket count
    2 × cluster parallelism)."""
    path = f"{sf}/documents.parquet"
    state = (spark.sparkContext.applicationId, Folder(spark, path).state(), stems)
    if state not in _INDEXES:
        _INDEXES[state] = S.store_index(Tables(spark, sf).documents, "doc_id", ["text"],
                                        scratch_path(spark, f"fts-index-{uuid.uuid4().hex}"),
                                        2 * spark.sparkContext.defaultParallelism, stems=stems)
    return _INDEXES[state]


def benchmark_queries(spark, sf):
    return Tables(spark, sf).benchmark.select(F.col("item_id").alias("query_id"), "text")


@query("fts_terms", bench=True, oracle=lambda: (
    _index_sql() + " select token, count(*) as df from idx group by token"))
def q_fts_terms(spark, sf):
    """Build the stored index (first use) and read its terms."""
    return stored_index(spark, sf).terms.where("token <> ''").select("token", "df")


@query("fts_match", bench=True, oracle=_match_sql)
def q_fts_match(spark, sf):
    return S.fts_match(stored_index(spark, sf), benchmark_queries(spark, sf), K)


@query("fts_match_words", oracle=_word_match_sql)
def q_fts_match_words(spark, sf):
    return S.fts_match(stored_index(spark, sf, stems=False), benchmark_queries(spark, sf), K)


# Phrases asked for: every run of three words that begins a sentence of a benchmark text.
_PHRASES_SQL = ("(select item_id * 1000 + generate_subscripts(ps, 1) as item_id, unnest(ps) as text from (select item_id, "
                "regexp_extract_all(text, '(?:^|[.!?]\\s+)([\\p{L}\\p{N}]+ [\\p{L}\\p{N}]+ [\\p{L}\\p{N}]+)', 1) as ps from "
                "benchmark) a)")


@query("fts_phrase", oracle=lambda: (
    f"with {_placed_sql('d', 'documents', 'doc_id')}, p as {_PHRASES_SQL}, {_placed_sql('q', 'p', 'item_id')}, n as (select "
    "item_id, count(*) as n from q group by item_id), found as (select q.item_id as query_id, d.doc_id, d.place - q.place + 1 "
    "as begins from q join d using (token) join n on n.item_id = q.item_id group by all having count(*) = max(n.n)) select "
    "query_id, doc_id, count(*) as hits, min(begins) as first_place from found group by query_id, doc_id"))
def q_fts_phrase(spark, sf):
    """Documents that hold the first three words of a sentence of a benchmark text side by side."""
    word = r"[\p{L}\p{N}]+"
    phrases = F.regexp_extract_all("text", F.lit(rf"(?:^|[.!?]\s+)({word} {word} {word})"), F.lit(1))
    asked = (Tables(spark, sf).benchmark.select("item_id", F.posexplode(phrases).alias("i", "text"))
             .select((F.col("item_id") * 1000 + F.col("i") + 1).alias("query_id"), "text"))
    return S.fts_phrase(stored_index(spark, sf), asked)


def label_centroids(t: Tables):
    """One query vector per label: the mean embedding of the label's vectors."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    avg = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("a"))
    return (avg.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "a"))).alias("_p"))
            .select(F.col("label").alias("query_id"), F.transform("_p", lambda p: p["a"]).alias("vector")))


_CENTROIDS_SQL = ("select label, list(a order by pos) as v from (select label, pos, avg(cast(x as double)) as a from "
                  "(select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from "
                  "embeddings) e group by label, pos) g group by label")


_COSINE_SQL = (
    f"with c as ({_CENTROIDS_SQL}), s as (select c.label as query_id, e.vec_id, round(list_cosine_similarity("
    "list_transform(e.embedding, lambda x: cast(x as double)), c.v), 6) as score from embeddings e, c) "
    "select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score "
    f"desc, vec_id) as rank from s) r where rank <= {K}")


@query("cosine_topk", bench=True, oracle=_COSINE_SQL)
def q_cosine_topk(spark, sf):
    t = Tables(spark, sf)
    return S.cosine_topk(t.embeddings, label_centroids(t), K)


@query("ivf_search")
def q_ivf_search(spark, sf):
    t = Tables(spark, sf)
    return S.ivf_search(t.embeddings, label_centroids(t), K, lists=16, probes=4, seed=42)


@query("ivf_search_all_cells", oracle=_COSINE_SQL)
def q_ivf_search_all_cells(spark, sf):
    """Probing every cell is exact."""
    t = Tables(spark, sf)
    return S.ivf_search(t.embeddings, label_centroids(t), K, lists=16, probes=16, seed=42)


@query("truncate_dims", oracle=(
    "select vec_id as id, list_transform(list_slice(embedding, 1, 32), lambda x: cast(x as double) / sqrt(list_sum("
    "list_transform(list_slice(embedding, 1, 32), lambda y: cast(y as double) * cast(y as double))))) as vector "
    "from embeddings"))
def q_truncate_dims(spark, sf):
    return S.truncate_dims(Tables(spark, sf).embeddings, "vec_id", "embedding", 32)


def _letters_sql(text: str) -> str:
    each = ", ".join(f"cast(length({text}) - length(replace({text}, '{c}', '')) as float)" for c in EMBED_LETTERS)
    return f"[{each}]"


@query("batch_embed", oracle=f"select doc_id as id, {_letters_sql('text')} as vector from documents")
def q_batch_embed(spark, sf):
    return S.batch_embed(Tables(spark, sf).documents, "doc_id", "text", S.letter_embedder(EMBED_LETTERS),
                         len(EMBED_LETTERS))


@query("resume_embed", oracle=(
    f"select doc_id as id, {_letters_sql('cut')} as vector from (select doc_id, left(text, 800) as cut from documents "
    "where text <> '' and doc_id not in (select doc_id from labels where doc_id is not null)) d"))
def q_resume_embed(spark, sf):
    t = Tables(spark, sf)
    src = t.documents.select(F.col("doc_id").alias("id"), "text")
    done = t.labels.select(F.col("doc_id").alias("id"))
    return S.resume_embed(src, done, S.letter_embedder(EMBED_LETTERS), len(EMBED_LETTERS))


def _hybrid_sql() -> str:
    def vec(t):
        return f"list_transform({_letters_sql(t)}, lambda x: cast(x as double))"
    return (
        f"with t as ({_match_sql()}), v as (select query_id, doc_id, row_number() over (partition by query_id order by "
        f"score desc, doc_id) as rank from (select b.item_id as query_id, d.doc_id, case when list_sum(d.v) = 0 or "
        "list_sum(b.v) = 0 then 0 else round(list_cosine_similarity(d.v, b.v), 6) end as score from"
        f" (select doc_id, {vec('text')} as v from documents) d, "
        f"(select item_id, {vec('text')} as v from benchmark) b) s qualify rank <= {K}), "
        "u as (select query_id, doc_id, rank from t union all select query_id, doc_id, rank from v), "
        "f as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score from u group by query_id, doc_id) "
        "select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score "
        f"desc, doc_id) as rank from f) r where rank <= {K}")


@query("hybrid_search", oracle=_hybrid_sql)
def q_hybrid_search(spark, sf):
    t = Tables(spark, sf)
    emb, dim = S.letter_embedder(EMBED_LETTERS), len(EMBED_LETTERS)
    doc_vecs = S.batch_embed(t.documents, "doc_id", "text", emb, dim)
    q_vecs = S.batch_embed(t.benchmark, "item_id", "text", emb, dim).withColumnRenamed("id", "query_id")
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text").join(q_vecs, on="query_id")
    return S.hybrid_search(stored_index(spark, sf), doc_vecs, queries, K, id_col="id", vec_col="vector")
