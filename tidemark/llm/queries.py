"""The thin queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import best_fit, html_text, importance, license_scan, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_rules, spelling, token_counts, topk

PACKING_TOKENIZER = "word_bpe_49k.json"
UNIGRAM_VOCABULARY = "piece_bpe_32k.model"
#: Target weights of the mixture, by node: the domains that are wanted more, and within them languages and a source.
MIX_WEIGHTS = {"domain0": 2.0, "domain1": 1.5, "domain3": 0.5, "domain0/en": 0.5, "domain1/es": 2.0, "domain1/en/src3": 3.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS, pass_on=True)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), keep=("url",))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("n_links")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(UNIGRAM_VOCABULARY))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


_ALL = (op1_line_dedup, op2_mixing, op3_lm_scoring, op4_html_text, op5_exact_topk, op6_packing, op7_license_scan, op8_quality_rules, op9_near_dedup, op10_token_counts, op11_spelling_variants, op12_importance_resampling, op13_best_fit_packing)
QUERIES = {f.__name__: f for f in _ALL}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
#: The unsigned crc32 of a text's UTF-8, over tab: a row with the list t of the checksums of single bytes.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, n: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"
_BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i::int + 1, 2))::bigint)"
_CRC = f"xor(list_reduce(list_concat([4294967295::bigint], {_BYTES}), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLE_SQL = {
    "op1_line_dedup": f"""
with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (select doc_id, parts, unnest(parts) as line, generate_subscripts(parts, 1) as pos from parts),
keyed as (select doc_id, pos, line, {_LOWER.format(f"trim(line, {_SPACE})")} as key from lines),
common as (select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.keeper as dropped from keyed k left join common c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
""",
    "op5_exact_topk": """
with x as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
v as (select vec_id, i, floor(64 * x::double)::bigint as x from x),
s as (select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score from v q join v c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
""",
    "op8_quality_rules": f"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as words, string_split(coalesce(text, ''), chr(10)) as parts from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from d),
win as (select doc_id, i, word, lead(word) over o as w2, lead(word, 2) over o as w3 from w window o as (partition by doc_id order by i)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, word, w2, w3) as n from win where w3 is not null) where n > 1),
hit as (select doc_id, count(distinct i + k) as n from rep, (values (0), (1), (2)) as t(k) group by doc_id),
l as (select doc_id, unnest(parts) as line from d),
dup as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n from l where trim(line, {_SPACE}) <> '' group by doc_id),
m as (select d.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
             coalesce(hit.n, 0)::bigint as n_repeat_words, coalesce(dup.n_lines, 0) as n_lines, length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) as n_letters
      from d left join dup using (doc_id) left join hit using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
            or (n_dup_lines > 3 and 10 * n_dup_lines > 3 * n_lines) or 10 * n_letters < 6 * word_chars) as kept
from b
""",
    "op9_near_dedup": f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
          else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
e as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * k >= 75 * (na.n + nb.n - k)),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.a, r.c from r join e on e.b = r.doc_id),
m as (select doc_id, min(c) as c from r group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, w.doc_id = m.c as kept
from w join m using (doc_id) left join n using (doc_id)
""",
    "op11_spelling_variants": f"""
with recursive tab as ({_CRC_TABLE}),
u as (select doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) as run from documents),
d as (select doc_id, run, count(*) as k from u where length(run) >= 7 group by all),
h as (select run, k, {_CRC.format("coalesce(doc_id::varchar, '') || ':' || run")} as h from d, tab),
m as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from h),
w as (select word, sum(k)::bigint as n from m where length(word) >= 7 group by word having sum(k) >= 2),
x as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
g as (select word, n, i, substr(word, 1, i::int - 1) as a, substr(word, i::int + 1) as z from x),
p as (select o.word, t.word as near, t.n as m from g o join g t on o.i = t.i and o.a = t.a and o.z = t.z and o.word <> t.word
      union select g.word, w.word, w.n from g join w on w.word = g.a || g.z
      union select w.word, g.word, g.n from g join w on w.word = g.a || g.z),
b as (select word, count(*) as n_near, min((-m, near)) as best from p group by word),
f as (select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when -best[1] >= 10 * w.n then best[2] end as form, case when -best[1] >= 10 * w.n then -best[1] end::bigint as form_n from w left join b using (word)),
r(word, root) as (select word, word from f where form is null union all select f.word, r.root from f join r on f.form = r.word)
select f.word, f.n, f.n_near, f.form, f.form_n, r.root from f join r using (word)
""",
    "op12_importance_resampling": f"""
with tab as ({_CRC_TABLE}),
d as (select doc_id, row_number() over () as place, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
q as (select unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from benchmark),
f as (select place, unnest(words) as word from d),
k as (select word, {_CRC.format("word")} % 10000 as bucket from (select word from f union select word from q), tab),
s as (select bucket, count(*) as s from f join k using (word) group by 1),
t as (select bucket, count(*) as t from q join k using (word) group by 1),
sums as (select (select count(*) from f)::double as s_all, (select count(*) from q)::double as t_all),
g as (select s.bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (s_all + 10000) / ((s::double + 1) * (t_all + 10000))))::bigint as gain from s left join t using (bucket), sums),
w as (select place, sum(gain)::bigint as weight from f join k using (word) join g using (bucket) group by 1),
c as (select doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join w using (place)),
e as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from c),
r as (select *, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from e where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from r
union all select doc_id, n_features, weight, score, null from e where n_features < 20
""",
}
