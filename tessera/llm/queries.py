"""One query per operator, over its whole table with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (ann, bpe, exact_dedup, langid, line_dedup, merkle, ngram_lm, packing, sharding, simhash, spelling,
                         topk, toxicity)
from tessera.llm.common import ASCII_LOWER, ASCII_UPPER, held_out, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Vocabulary files of the packing and byte-level BPE queries.
PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, docs.where(~held_out("doc_id", 5, 0)))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "letters",
                      "phrase_letters")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACKING_TOKENIZER)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id", 3, 1))
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


_NORMAL = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')"


@query("op8_exact_dedup", (
    f"with t as (select doc_id, {_NORMAL} as n from documents), g as (select n, max(doc_id) as keep_id, count(*) as "
    "group_size from t group by n) select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.n) as "
    "text_sha256 from t join g on t.n = g.n"))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_Q = "list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))"
_OK = ("embedding is not null and len(embedding) > 0 and vec_id is not null and len(list_filter(embedding, lambda x: "
       "x is null or not isfinite(x))) = 0")


@query("op10_top_k", (
    f"with v as (select vec_id, {_Q} as e from embeddings where {_OK}), s as (select q.vec_id as query_id, r.vec_id, "
    "cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i])) as bigint) as score from v q, v "
    "r where q.vec_id % 50 = 0 and r.vec_id <> q.vec_id and len(q.e) = len(r.e)) select query_id, rank, vec_id, score "
    "from (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank "
    "from s) t where rank <= 5"))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", "n_lines", "n_deleted", "emptied")


@query("op7_ngram_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


@query("op11_ann")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable_vectors(table(spark, sf_dir, "embeddings"))
    return ann.search(ann.build(rows), rows.where(F.col("vec_id") % 100 == 0), 10)


#: CRC-32 (reflected polynomial 0xEDB88320) of a string's UTF-8 bytes: a table made by rule, one step per byte.
_CRC_TABLE = ("crc_table as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 "
              "= 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(i as bigint))) as steps)")


def _crc(text: str) -> str:
    byte = f"cast('0x' || substr(hex(encode({text})), cast(2 * i + 1 as integer), 2) as bigint)"
    return (f"xor(4294967295, list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: {byte}), lambda c, b: "
            "xor(c >> 8, steps[cast((xor(c, b) & 255) + 1 as integer)]), 4294967295))")


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in (*merkle.FIELDS[:-1], text))})"


def _tree(name: str, leaves: str) -> str:
    """Nodes of the trees over ``leaves`` (tree, j, digest, cnt), and what stands left and right of each."""
    return (f"{name} as (select tree, 0 as level, j, digest, cnt from {leaves} union all select tree, level + 1, j // 8, "
            "sha256(string_agg(digest, '' order by j)), (cnt + 7) // 8 from {0} where cnt > 1 group by tree, level, j // 8, "
            "cnt), {0}_sides as (select a.tree, a.level, a.j, coalesce(string_agg(b.digest, '' order by b.j) filter (b.j < "
            "a.j), '') as l, coalesce(string_agg(b.digest, '' order by b.j) filter (b.j > a.j), '') as r from {0} a join {0} "
            "b on a.tree = b.tree and a.level = b.level and a.j // 8 = b.j // 8 where a.cnt > 1 group by all)").replace(
                "{0}", name)


def _climb(name: str, start: str, tree: str) -> str:
    """From (id, tree, level, j, acc, proof) up to the root of ``tree``."""
    return (f"{name} as (select * from {start} union all select c.id, c.tree, c.level + 1, c.j // 8, sha256(s.l || c.acc || "
            f"s.r), c.proof || s.l || s.r from {name} c join {tree}_sides s on c.tree = s.tree and c.level = s.level and c.j "
            "= s.j)")


_OP12 = (
    f"with recursive {_CRC_TABLE}, d as (select row_number() over () as id, doc_id, coalesce('=' || lang, '') as tree, "
    f"{_leaf('text')} as leaf, case when {_crc('cast(doc_id as varchar)')} % 3 = 0 then {_leaf('low')} end as shown from "
    f"(select *, translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}') as low from documents) t, crc_table), "
    "p as (select id, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as j, leaf as "
    "digest, coalesce(shown, leaf) as shown, doc_id, count(*) over (partition by tree) as cnt from d), "
    + _tree("low", "p") + ", subs as (select '' as tree, row_number() over (order by tree) - 1 as j, digest, count(*) over "
    "() as cnt, tree as name from low where cnt = 1), " + _tree("top", "subs")
    + ", begin_own as (select id, tree, 0 as level, j, shown as acc, '' as proof from p), "
    + _climb("own", "begin_own", "low")
    + ", begin_top as (select o.id, '' as tree, 0 as level, s.j, o.acc, o.proof from (select id, tree, acc, proof from own "
    "qualify row_number() over (partition by id order by level desc) = 1) o join subs s on o.tree = s.name), "
    + _climb("whole", "begin_top", "top")
    + " select p.doc_id, p.digest as leaf, s.digest as subroot, t.digest as root, sha256(w.proof) as proof_sha256, w.acc as "
    "folded_root, w.acc = t.digest as verified from p join subs s on p.tree = s.name join (select digest from top where cnt "
    "= 1) t on true join (select * from whole qualify row_number() over (partition by id order by level desc) = 1) w on "
    "w.id = p.id")


@query("op12_merkle", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *others, text = [F.col(c) for c in merkle.FIELDS]
    low = merkle.leaf_digest(*others, F.when(text.isNotNull(), exact_dedup.normalised(text)))
    m = merkle.build(docs, merkle.leaf_digest(*others, text), part=F.col("lang"), key=F.col("doc_id"),
                     presented=F.when(held_out("doc_id", 3, 0), low))
    return merkle.proofs(m).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                   "verified")


_OP13 = (
    f"with recursive {_CRC_TABLE}, runs as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all("
    f"translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents) t where "
    f"length(run) >= 6 group by all), hashed as (select run, c, {_crc("coalesce(doc_id || ':' || run, '')")} as h, doc_id from "
    "runs, crc_table), words as (select word, cast(sum(c) as bigint) as n from (select case when doc_id is not null and h % "
    "199 = 0 then substr(run, 1, cast(h % length(run) as integer)) || substr(run, cast(h % length(run) as integer) + 2) else "
    "run end as word, c from hashed) t where length(word) >= 6 group by word having sum(c) >= 5), cuts as (select word, p, "
    "substr(word, 1, cast(p as integer)) || substr(word, cast(p as integer) + 2) as cut from (select word, "
    "unnest(range(length(word))) as p from words) t), near as (select a.word, b.word as other from cuts a join cuts b on a.p "
    "= b.p and a.cut = b.cut and a.word <> b.word union select c.word, w.word from cuts c join words w on c.cut = w.word "
    "union select w.word, c.word from cuts c join words w on c.cut = w.word), best as (select near.word, count(*) as n_near, "
    "arg_min(o.word, (-o.n, o.word)) as form, max(o.n) as form_n from near join words o on o.word = near.other group by "
    "near.word), judged as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * w.n then form end as "
    "form, case when form_n >= 5 * w.n then form_n end as form_n from words w left join best using (word)), climb as (select "
    "word, word as top, 0 as steps from words union all select c.word, j.form, steps + 1 from climb c join judged j on c.top = "
    "j.word where j.form is not null) select j.word, j.form, c.top as root, j.n, j.n_near, j.form_n from judged j join "
    "(select word, arg_max(top, steps) as top from climb group by word) c using (word)")


@query("op13_spelling", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.count_words(table(spark, sf_dir, "documents"), spelling.latin_words()))
