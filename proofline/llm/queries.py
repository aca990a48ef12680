"""One registered query per operator, with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .best_fit import best_fit
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .langid import identify_held_out
from .line_dedup import line_dedup
from .merkle import digest, fold, manifest, proof_digest
from .minhash import near_dedup
from .packing import pack
from .pii import pii_surrogates
from .sentencepiece import sentencepiece_digest
from .spelling import LOWER, UPPER, spelling_variants, vocabulary
from .toxicity import toxicity_held_out
from .url_filter import url_filter

KEY = "proofline"  # a production run takes its key from the caller
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query("op3_url_filter", f"""
with rules(h, p, v) as (values {RULES_SQL}),
rest as (select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as r from pages),
parsed as (select page_id, {LOWER_SQL.format("regexp_extract(r, '^[^/?#]*', 0)")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
fits as (select page_id, host, path, h || p as rule, v from parsed join rules
  on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
won as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from fits group by 1, 2, 3)
select p.page_id, p.host, p.path, w.rule, coalesce(w.v, 'allow') as verdict
from parsed p left join won w on p.page_id = w.page_id and p.host = w.host and p.path = w.path""")
def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


@query("op4_line_dedup", f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, i, lines[i] as line, {LOWER_SQL.format(f"trim(lines[i], {BLANKS_SQL})")} as k
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from split)),
often as (select k from lines where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (k in (select k from often)) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (k not in (select k from often)), '')) as kept_sha256
from lines group by doc_id""")
def op4_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_exact_dedup", """
with rows as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from rows""")
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def tokenizer_file(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_sentencepiece")
def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), window=1024, end_id=0).drop("ids")


@query("op5_pii")
def op5_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = pii_surrogates(docs, KEY, keep=("lang", "source"))
    return out.withColumn("text_sha256", F.sha2("text", 256))


@query("op6_embedding_dedup")
def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op8_minhash")
def op8_minhash(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), threshold=0.8)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    return identify_held_out(table(spark, sf_dir, "documents"))


# CRC-32 of a list of byte values, by its table of 256 entries
CRC_TABLE_SQL = """crc as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, list_transform(range(8), lambda z: 0::bigint)),
  lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
BYTES_SQL = """flatten(list_transform(string_split({}, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint]
  else [(192 + unicode(ch) // 64)::bigint, (128 + unicode(ch) % 64)::bigint] end))"""


def _merkle_sql(depth: int, top: int) -> str:
    """Trees of up to 8^depth leaves per language and 8^top languages, level by level."""
    def field(x):
        return f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(rows, nodes, group, levels):
        out = []
        for k in range(levels):
            out.append(f"""{nodes}{k}g as (select {group}, pos // 8 as up, max(n) as n, list(h order by pos) as hs
  from (select *, count(*) over (partition by {group}) as n from {nodes}{k}) group by {group}, pos // 8),
{nodes}{k + 1} as (select {group}, up as pos, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from {nodes}{k}g),
{rows}{k + 1} as (select r.* replace (r.pos // 8 as pos,
    case when n = 1 then f else sha256(array_to_string(list_transform(hs, lambda x, i: case when i = r.pos % 8 + 1 then f else x end), '')) end as f,
    case when n = 1 then proof else proof || array_to_string(list_filter(hs, lambda x, i: i <> r.pos % 8 + 1), '') end as proof)
  from {rows}{k} r join {nodes}{k}g g on r.{group} is not distinct from g.{group} and r.pos // 8 = g.up)""")
        return ",\n".join(out)
    lower = LOWER_SQL.format("text")
    crc = CRC_SQL.format(bytes="list_transform(string_split(doc_id::varchar, ''), lambda ch: unicode(ch)::bigint)")
    return f"""
with {CRC_TABLE_SQL},
told as (select doc_id, lang, {leaf("text")} as leaf, case when {crc} % 3 = 0 then {leaf(lower)} else {leaf("text")} end as f from documents, crc),
a0 as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, '' as proof from told),
x0 as (select lang, pos, leaf as h from a0),
{climb("a", "x", "lang", depth)},
y0 as (select 0 as one, lang, row_number() over (order by lang nulls first) - 1 as pos, h from x{depth}),
b0 as (select a.* exclude (pos), y.one, y.pos, y.h as subroot from a{depth} a join y0 y on a.lang is not distinct from y.lang),
{climb("b", "y", "one", top)}
select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from b{top} join y{top} using (one)"""


@query("op11_merkle", _merkle_sql(8, 3))
def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    leaves = docs.select("doc_id", "lang", digest(*fields, F.col("text")).alias("leaf"),
                         F.when(tampered, digest(*fields, F.translate("text", UPPER, LOWER))).alias("other"))
    out = manifest(leaves, "doc_id", "lang")
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
                      fold(F.coalesce("other", "leaf"), F.col("steps")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_best_fit")
def op12_best_fit(spark, sf_dir):
    return best_fit(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), size=2048, end_id=0).drop("ids")


@query("op13_spelling", f"""
with recursive {CRC_TABLE_SQL},
runs as (select doc_id, {LOWER_SQL.format("run")} as run, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all),
coded as (select *, coalesce({CRC_SQL.format(bytes=BYTES_SQL.format("doc_id::varchar || ':' || run"))}, 1) as h from runs, crc),
slips as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, k from coded),
words as (select word, sum(k)::bigint as n from slips where length(word) >= 6 group by word having sum(k) >= 5),
cropped as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as d from (select word, n, unnest(range(length(word))) as i from words)),
near as (select distinct a.word as a, b.word as b, b.n from cropped a join cropped b on a.d = b.d and a.i = b.i and a.word <> b.word
  union select distinct a.word, b.word, b.n from cropped a join words b on a.d = b.word
  union select distinct b.word, a.word, a.n from cropped a join words b on a.d = b.word),
best as (select a, count(*) as n_near, min(struct_pack(m := -n, w := b)) as best from near group by a),
forms as (select word, n, coalesce(n_near, 0) as n_near, case when -best.m >= 5 * n then best.w end as form,
  case when -best.m >= 5 * n then -best.m end as form_n from words left join best on a = word),
ways as (select word, word as here from words union all select ways.word, form from ways join forms on forms.word = ways.here where form is not null),
roots as (select word, here as root from ways join (select word as w from forms where form is null) on w = here)
select word, form, root, n, n_near, form_n from forms join roots using (word)""")
def op13_spelling(spark, sf_dir):
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents")))
