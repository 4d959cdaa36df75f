"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlake.llm.common import documents

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.jaccard import jaccard_classes

    return jaccard_classes(documents(spark, sf_dir))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.fingerprint import compare_edited

    return compare_edited(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.sharding import shard_by_size

    return shard_by_size(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.suffix import dedup_report

    return dedup_report(documents(spark, sf_dir))


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.hmm import score_documents

    return score_documents(documents(spark, sf_dir))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.bpe import digest_documents

    return digest_documents(documents(spark, sf_dir), vocabulary())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.toxicity import score_documents, train

    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary())


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.embeddings import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.chat import format_conversations, probe_rows

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_conversations(rows.unionByName(probe_rows(spark)))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.divergence import source_divergence

    return source_divergence(documents(spark, sf_dir))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.pii import find_spans, labelled_table, train

    return find_spans(documents(spark, sf_dir), train(labelled_table(spark)))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlake.llm.alignment import align_tokens

    return align_tokens(documents(spark, sf_dir), vocabulary(), vocabulary(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_document_fingerprints, op3_sharding, op4_suffix_dedup, op5_hidden_markov, op6_bpe_automaton, op7_toxicity, op8_packing, op9_near_vectors, op10_chat_formatting,
        op11_source_divergence, op12_personal_data, op13_token_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op10_chat_formatting": """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc as (
  select *, replace(replace(replace(replace(replace(role || chr(0) || text, '~', '~0'), '<', '~1'), '[', '~2'), '>', '~3'), ']', '~4') as e from rows),
made as (
  select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length(e) - 1 + 8 + 8 + 7)::bigint as formatted_chars,
    case when string_agg(role, ',' order by turn nulls first, role, text) = 'user,assistant' and count(*) = 2 then 'prompt' when (conv_id % 3 + 3) % 3 = 0 then 'messages'
      when (conv_id % 3 + 3) % 3 = 1 and not bool_or(role in ('human', 'gpt')) then 'conversations' else 'rows' end as layout
  from esc group by conv_id)
select *, sha256(case layout when 'prompt' then 'prompt,response' when 'messages' then 'messages[].content,messages[].role' when 'conversations' then 'conversations[].from,conversations[].value' else 'rows[].role,rows[].text,rows[].turn' end) as schema_fingerprint from made""",
    # Shingles of five words as text; classes are what links reach.
    "op1_ngram_jaccard": """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') as words from documents where doc_id is not null),
s as (select doc_id, unnest(list_distinct([array_to_string(words[i : i + 4], ' ') for i in range(1, greatest(1, len(words) - 4) + 1)])) as shingle from w where len(words) > 0),
n as (select doc_id, count(*) as n from s group by 1),
met as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (select met.a, met.b, shared = x.n and shared = y.n as same from met join n x on x.doc_id = a join n y on y.doc_id = b where shared * 1000000 >= 800000 * (x.n + y.n - shared)),
reach(a, b) as (select doc_id, doc_id from documents where doc_id is not null union select r.a, l.b from reach r join links l on r.b = l.a),
classes as (select a as doc_id, min(b) as class_id from reach group by 1),
counts as (select a as doc_id, count(*) as n_links, min(case when same then b end) as same from links group by 1)
select c.doc_id, least(c.doc_id, coalesce(k.same, c.doc_id)) as copy_id, coalesce(k.n_links, 0) as n_links, c.class_id, c.class_id = c.doc_id as kept from classes c left join counts k using (doc_id)""",
    # Strings of 50 bytes as hexadecimal text, cut from pieces of a thousand starts.
    "op4_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
c as (select doc_id, 1000 * k as base, substr(h, 2000 * k + 1, 2098) as piece from (select doc_id, h, unnest(range(0, (greatest(n, 1) + 999) // 1000)) as k from d)),
w as (select doc_id, base + p as pos, substr(piece, 2 * p + 1, 100) as s from (select doc_id, base, piece, unnest(range(0, least(1000, greatest(0, length(piece) // 2 - 49)))) as p from c)),
f as (select s, min(doc_id) as least_id from w group by s having count(*) > 1),
hit as (select w.doc_id, w.pos from w join f on w.s = f.s where f.least_id < w.doc_id),
runs as (select doc_id, pos, sum(case when pos > prev + 50 or prev is null then 1 else 0 end) over (partition by doc_id order by pos) as nth from (select *, lag(pos) over (partition by doc_id order by pos) as prev from hit)),
r as (select doc_id, nth, min(pos) as low, max(pos) + 50 as stop from runs group by 1, 2),
e as (select *, coalesce(lag(stop) over (partition by doc_id order by nth), 0) as prev from r),
k as (select e.doc_id, sum(stop - low)::bigint as removed, count(*) as spans, string_agg(substr(d.h, 2 * prev + 1, 2 * (low - prev)), '' order by nth) as head, max(stop) as tail from e join d on d.doc_id = e.doc_id group by 1)
select d.doc_id, d.n::bigint as n_bytes, coalesce(k.removed, 0)::bigint as n_removed, coalesce(k.spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k.head, '') || substr(d.h, 2 * coalesce(k.tail, 0) + 1))) as kept_sha256
from d left join k on d.doc_id = k.doc_id""",
    "op9_near_vectors": """
with recursive good as (
  select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98::double),
reach(a, b) as (select vec_id, vec_id from embeddings where vec_id is not null union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a as vec_id, min(b) as component_id from reach group by 1),
counts as (select a as vec_id, count(*) as n_links from links group by 1)
select r.vec_id, coalesce(n_links, 0) as n_links, component_id, component_id = r.vec_id as kept from roots r left join counts c on c.vec_id = r.vec_id""",
    # Every group against every kept term of its language, absent ones counted as 0.
    "op11_source_divergence": """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term from w group by 1, 2 having count(distinct r) >= 3),
sizes as (select lang, count(*) as v from kept group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by 1, 2, 3),
full_c as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n from g join kept on kept.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
p as (select f.lang, f.source, f.term, f.n, 1 + (1000000000::hugeint * (f.n + 1)) // (sum(f.n) over (partition by f.lang, f.source) + s.v) as p from full_c f join sizes s on s.lang = f.lang),
lang_n as (select lang, term, sum(n) as n from c group by 1, 2),
q as (select l.lang, l.term, 1 + (1000000000::hugeint * (l.n + 1)) // (sum(l.n) over (partition by l.lang) + s.v) as q from lang_n l join sizes s on s.lang = l.lang),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as other, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3) x on x.lang = a.lang and x.source = a.source and x.other = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, (((p.p - q.q) * (p.p - q.q)) // q.q)::bigint as value from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200""",
}
