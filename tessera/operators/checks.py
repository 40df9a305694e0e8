"""Data checks: required fields, unique keys, one owner per exploded value, foreign keys, secret-looking values,
document rules, image links and backup freshness. Each check returns violation rows (rule, key, detail) or a
per-subject verdict; none gathers data on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import RULES_MAX_ROWS, compiled_rules
from tessera.operators.layout import spread

VIOLATION_COLS = ["rule", "key", "detail"]


def required_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One violation per missing or empty field."""
    missing = F.array_compact(F.array(*[
        F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(missing).alias("detail")) \
        .select(F.lit("required").alias("rule"), "key", "detail")


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (count as detail)."""
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    return (df.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .select(F.lit("unique").alias("rule"), "key", F.col("n").cast("string").alias("detail")))


def unique_exploded(df: DataFrame, owner: str, array_col: str) -> DataFrame:
    """A value (e.g. a host) may belong to one record only; every owner of a shared value is reported. Owners
    per value are counted by an aggregate (deduplicated (value, owner) pairs, combined map-side). The shared values
    are dealt by another hash before they are joined back: both join sides are then shuffled for the join itself, and
    adaptive execution can split a value that a third of all records share."""
    pairs = df.select(F.col(owner).cast("string").alias("owner"), F.explode(F.col(array_col)).alias("value")) \
        .where(F.col("value").isNotNull()).distinct()
    shared = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    shared = shared.repartition(F.xxhash64("value"))
    return (pairs.join(shared, on="value", how="left_semi")
            .select(F.lit("unique_value").alias("rule"), F.col("value").alias("key"), F.col("owner").alias("detail")))


def foreign_key(df: DataFrame, key: str, ref_col: str, parent: DataFrame, parent_key: str, rule: str,
                when: Column | None = None) -> DataFrame:
    """Rows (optionally only those matching ``when``) whose reference is not a parent key."""
    d = df if when is None else df.where(when)
    p = parent.select(F.col(parent_key).alias("_pk")).where(F.col("_pk").isNotNull()).distinct()
    bad = d.join(p, d[ref_col] == p["_pk"], "left_anti")
    return bad.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"),
                      F.coalesce(F.col(ref_col).cast("string"), F.lit("null")).alias("detail"))


# Secret-looking assignment and the words that mark a placeholder.
SECRET_PATTERN = r"(?i)(senha|password|secret|token)\s*[:=]\s*[\"']?([A-Za-z0-9_\-]{16,})"
PLACEHOLDER_PATTERN = r"(?i)your|change|exemplo|example|xxx|placeholder|default|endpoint-proxy|seu-|sua-"


def secret_scan(docs: DataFrame, id_col: str, text_col: str, pattern: str = SECRET_PATTERN,
                placeholders: str = PLACEHOLDER_PATTERN) -> DataFrame:
    """Per document: key names of secret-looking assignments whose value is not a placeholder. The value itself
    is never emitted, only the key name and the number of hits."""
    t = F.col(text_col)
    names = F.regexp_extract_all(t, F.lit(pattern), 1)
    values = F.regexp_extract_all(t, F.lit(pattern), 2)
    pairs = F.arrays_zip(names.alias("n"), values.alias("v"))
    real = F.filter(pairs, lambda p: ~p["v"].rlike(placeholders))
    out = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), _nonempty(real).alias("_hits"))
    return out.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda p: F.lower(p["n"])))),
                                             ",").alias("key_name"),
                      F.size("_hits").alias("hits"))


ANY_ADDRESS = r"https?://[a-z0-9.-]+\.[a-z]{2,}"
# The named parts every README must have (name, case-insensitive pattern). The "where it runs" rule
# accepts any web address; ``readme_rules`` narrows it to given domains.
DOCUMENT_RULES = [
    ("o que é", r"o que [eé]|sobre|vis[aã]o geral"),
    ("onde está no ar", r"no ar|endere[cç]o|produ[cç][aã]o|" + ANY_ADDRESS),
    ("onde faz o deploy", r"deploy"),
    ("como funciona por dentro", r"como funciona|arquitetura|por dentro"),
    ("segredos (onde ficam, nunca valores)", r"segredo|infisical|\.env"),
    ("como rodar e testar", r"test|rodar local|localmente|pytest|npm (run )?test"),
    ("dono e links", r"dono|spec|kuma|monitor|painel"),
]


def readme_rules(domains: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """The README rules; with ``domains``, only an address of one of them says where something runs."""
    if not domains:
        return list(DOCUMENT_RULES)
    named = "(" + "|".join(re.escape(d.lower()) for d in domains) + ")"
    return [(name, pattern.replace(ANY_ADDRESS, named)) for name, pattern in DOCUMENT_RULES]


def document_rules(docs: DataFrame, id_col: str, text_col: str, rules_df: DataFrame) -> DataFrame:
    """Per document: the names of the rules (name, pattern) it does not match, joined in rule order; documents
    that match every rule are left out. Rules are compiled into one literal ``rlike`` each, so each pattern is compiled
    once per task and each document is tested in place — no documents × rules row product. More rules than one block
    holds are tested block by block over the documents, and the blocks' names put together in rule order."""
    ordered = rules_df.select("rank", "name", "pattern").orderBy("rank")
    rules = compiled_rules(ordered)
    blocks = [rules] if rules is not None else _rule_blocks(ordered)
    staged = spread(docs.select(id_col, text_col)).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    staged = staged.select("doc_id", "_t", F.lower("_t").alias("_low"))
    out = None
    for n, block in enumerate(blocks):
        part = staged.select("doc_id", _nonempty(_missing_names(block)).alias("_m")).withColumn("_b", F.lit(n))
        out = part if out is None else out.unionByName(part)
    if rules is None:
        out = out.groupBy("doc_id").agg(F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct("_b", "_m"))), lambda x: x["_m"])).alias("_m"))
    return out.select("doc_id", F.array_join("_m", "; ").alias("missing"))


def _rule_blocks(ordered: DataFrame):
    """The rules in blocks that one projection can hold, read one partition at a time."""
    block: list = []
    for r in ordered.toLocalIterator():
        block.append(r)
        if len(block) == RULES_MAX_ROWS:
            yield block
            block = []
    if block:
        yield block


def _missing_names(rules: list):
    t, low = F.col("_t"), F.col("_low")

    # Case-insensitive with Unicode case folding, as the original rules match. A pattern written in lower case
    # is matched against the text lower-cased once, in its own projection (much cheaper than the regex engine's
    # Unicode case mode, and not repeated per rule); any other pattern uses the (?iu) flags.
    def fails(p: str):
        return ~low.rlike(p) if p == p.lower() else ~t.rlike("(?iu)" + p)
    return F.array_compact(F.array(*[F.when(fails(r["pattern"]), F.lit(r["name"])) for r in rules]))


def _nonempty(arr):
    """One row when ``arr`` is not empty, none otherwise — dropped by a generator in the same stage as the
    per-row work. (A plain filter on the result would be pushed below the re-split exchange into the scan.)"""
    return F.explode(F.filter(F.array(arr), lambda a: F.size(a) > 0))


# Markdown and HTML image targets.
IMAGE_PATTERN = r"!\[[^\]]*\]\(([^)\s]+)\)|<img [^>]*src=\"([^\"]+)\""


def image_links(docs: DataFrame, id_col: str, text_col: str, pattern: str = IMAGE_PATTERN) -> DataFrame:
    """Image targets per document (either syntax), local when not starting with 'http'; a document without any
    image gives one row with a null target (the violation)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    md = F.regexp_extract_all(t, F.lit(pattern), 1)
    html = F.regexp_extract_all(t, F.lit(pattern), 2)
    targets = F.filter(F.zip_with(md, html, lambda a, b: F.when(a != "", a).otherwise(b)), lambda x: x != "")
    out = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"),
                                                       F.explode_outer(targets).alias("target"))
    return out.withColumn("is_local", F.when(F.col("target").isNotNull(), ~F.col("target").startswith("http")))


# Freshness limit of the last good backup.
MAX_AGE_HOURS = 26


def freshness_alert(runs_df: DataFrame, now: str, max_age_hours: int = MAX_AGE_HOURS) -> DataFrame:
    """Per subject (e.g. a backup job), from its run records (subject, kind 'ok'/'fail'/'verify', finished_at,
    flag, reason): the problems list — no OK record; last OK older than the limit; OK record with a false flag;
    a failure newer than the last OK; last verification failed. alert = any problem. A run record without a time is
    unreadable and a problem of its own; it is no run."""
    k = F.col("kind")
    unreadable = F.count_if((k == "ok") & F.col("finished_at").isNull())
    agg = runs_df.groupBy("subject").agg(
        F.max_by(F.struct("finished_at", "flag"), F.when(k == "ok", F.col("finished_at"))).alias("_ok"),
        F.max_by(F.struct("finished_at", "reason"), F.when(k == "fail", F.col("finished_at"))).alias("_fail"),
        F.max_by(F.col("flag"), F.when(k == "verify", F.col("finished_at"))).alias("_verify"),
        unreadable.alias("_unreadable"))
    now_c = F.lit(now).cast("timestamp")
    age_h = (F.unix_seconds(now_c) - F.unix_seconds(F.col("_ok.finished_at").cast("timestamp"))) / 3600
    problems = F.array_compact(F.array(
        F.when(F.col("_unreadable") > 0, F.lit("unreadable run record")),
        F.when(F.col("_ok").isNull() & (F.col("_unreadable") == 0), F.lit("no successful run")),
        F.when(F.col("_ok").isNotNull() & (age_h > max_age_hours),
               F.concat(F.lit("last successful run "), F.floor(age_h).cast("string"), F.lit("h ago"))),
        F.when(F.col("_ok").isNotNull() & ~F.coalesce(F.col("_ok.flag"), F.lit(False)), F.lit("ok record not ok")),
        F.when(F.col("_fail").isNotNull() & (F.col("_ok").isNull()
                                            | (F.col("_fail.finished_at") > F.col("_ok.finished_at"))),
               F.concat(F.lit("failed at "), F.date_format(F.col("_fail.finished_at"), "yyyy-MM-dd HH:mm:ss"),
                        F.lit(": "),
                        F.coalesce(F.col("_fail.reason"), F.lit("")))),
        F.when(F.col("_verify").isNotNull() & ~F.col("_verify"), F.lit("restore verification failed"))))
    return agg.select("subject", (F.size(problems) > 0).alias("alert"),
                      F.array_join(problems, "; ").alias("problems"))
