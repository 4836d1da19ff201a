"""DuckDB SQL for the retrieval queries: the same results from an independent formulation.

A query names the common tables it stands on; `sql` puts them, and what they stand on, in front.
"""

from __future__ import annotations

import re

from ..functions.text import ENTITY_PATTERNS, TOKEN_PATTERN
from ..operators.rag import CLOSING, EXCERPTS_HEADING, QUESTION_PREFIX, TOP_K
from ..operators.significance import RESAMPLES

_WORD = r"[^ \t\n\r\f]+"
_TOKENS = "list_transform(regexp_extract_all(lower({0}), '" + TOKEN_PATTERN + "'), lambda t: rtrim(t, '.'))"
_BEST = "row_number() over (partition by query_id order by round(score, 6) desc, doc_id)"
_BIGRAMS = "list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])"
_METRICS = ("ndcg@10", "recall@10", "mrr@10", "ndcg@100", "recall@100", "mrr@100")


def _bm25(name: str, n: int) -> str:
    dl, avg = (("tf.n_tokens", "mean") if n == 1 else ("(2 * tf.n_tokens - 1)", "(2 * mean - 1)"))
    part = f"idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * {dl} / {avg}))"
    return f"select q.query_id, tf.doc_id, sum({part}) score from tf join idf using (gram) join qgram q using (gram), cst where tf.n <= {n} group by all"


def _dense(name: str, score: str) -> str:
    return f"select q.vec_id::varchar query_id, d.vec_id::varchar doc_id, {score} score from emb q, emb d where q.vec_id % 100 = 0"


TABLES = {
    "words": f"select doc_id, regexp_extract_all(text, '{_WORD}') w from documents",
    "cuts": "select doc_id, unnest(range(0, (len(w) - 1) // 350 + 1)) c, w from words where len(w) > 0",
    "passages": "select doc_id || '_' || c doc_id, doc_id::varchar did, array_to_string(w[c * 350 + 1 : c * 350 + 350], ' ') \"text\" from cuts",
    "pid2did": "select doc_id, did from passages",
    "queries": f"select item_id::varchar query_id, item_id q_ord, array_to_string(regexp_extract_all(text, '{_WORD}'), ' ') query from benchmark",
    "qrels": "select distinct q.query_id, p.doc_id, 1::integer grade from queries q join passages p on contains(p.text, q.query)",
    "ptok": f"select doc_id, {_TOKENS.format('text')} t from passages",
    "qtok": f"select query_id, {_TOKENS.format('query')} t from queries",
    "pgram": f"select doc_id, n_tokens, g, n from (select doc_id, len(t) n_tokens, unnest(t) g, 1 n from ptok union all select doc_id, len(t), unnest({_BIGRAMS}), 2 from ptok)",
    "qgram": f"select distinct query_id, gram, n from (select query_id, unnest(t) gram, 1 n from qtok union all select query_id, unnest({_BIGRAMS}), 2 from qtok)",
    "tf": "select doc_id, g gram, n, n_tokens, count(*) tf from pgram where g in (select gram from qgram) group by all",
    "df": "select gram, count(*) df from tf group by gram",
    "cst": "select count(*)::double n_docs, avg(len(t)) mean from ptok",
    "idf": "select gram, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) idf from df, cst",
    "bm1": _bm25("bm1", 1),
    "bm2": _bm25("bm2", 2),
    "run1": f"select *, {_BEST} rank from bm1 qualify rank <= 100",
    "run2": f"select *, {_BEST} rank from bm2 qualify rank <= 100",
    "enc": "select doc_id, g gram, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (2 * n_tokens - 1) / (2 * round_even(mean, 0) - 1))) val from (select doc_id, g, n_tokens, count(*) tf from pgram group by all), cst",
    "crc_steps": "select list_transform(range(256), lambda n: list_reduce(list_concat([n::ubigint], list_transform(range(8), lambda i: 0::ubigint)), lambda c, i: case when c % 2 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end)) tab",
    "enc_crc": "select gram, xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::ubigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255::ubigint)::int + 1]))) idx from (select gram, hex(encode(gram)) h from (select distinct gram from enc)), crc_steps",
    "enc_idx": "select doc_id, idx, sum(val) val from enc join enc_crc using (gram) group by all",
    "sparse": "select q.query_id, e.doc_id, sum(e.val * idf.idf) score from enc e join qgram q using (gram) join idf using (gram) group by all",
    "sparse_tf": "select q.query_id, e.doc_id, sum(e.val) score from enc e join qgram q using (gram) group by all",
    "run_tf": f"select *, {_BEST} rank from sparse_tf qualify rank <= 100",
    "neg": f"select query_id, doc_id from (select b.query_id, b.doc_id, b.score from bm1 b where b.query_id in (select query_id from qrels) and (b.query_id, b.doc_id) not in (select query_id, doc_id from qrels)) qualify {_BEST} <= 20",
    "emb": "select vec_id, embedding::double[] e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) norm from embeddings",
    "mv": "select (vec_id // 8)::bigint m, (vec_id // 8)::varchar doc_id, list(embedding::double[] order by vec_id) vecs from embeddings group by all",
    "heads": "select m, doc_id, vecs, vecs[1] head, vecs[-1] tail from mv",
    "head_hits": "select q.doc_id query_id, d.doc_id, list_cosine_similarity(q.head, d.head) score from heads q, heads d where q.m % 100 = 0",
    "tail_hits": "select q.doc_id query_id, d.doc_id, list_cosine_similarity(q.tail, d.tail) score from heads q, heads d where q.m % 100 = 0",
    "maxsim": "select q.doc_id query_id, d.doc_id, list_sum(list_transform(q.vecs, lambda x: list_max(list_transform(d.vecs, lambda y: list_dot_product(x, y))))) score from mv q, mv d where q.m % 100 = 0",
    "fusable": f"select query_id, doc_id, score, {_BEST} rank, 1 arm from bm1 qualify rank <= 50 union all select query_id, doc_id, score, {_BEST} rank, 2 arm from bm2 qualify rank <= 50",
    "sib": "select distinct d.query_id, p.doc_id from (select distinct q.query_id, p.did from qrels q join pid2did p using (doc_id)) d join pid2did p using (did) where (d.query_id, p.doc_id) not in (select query_id, doc_id from qrels)",
    "sibq": "select query_id, doc_id, 2::integer grade from qrels union all select query_id, doc_id, 1::integer from sib",
    "pool": f"select query_id, doc_id, score, {_BEST} in_rank from bm1 qualify in_rank <= 100",
    "training": """select row_id, md5(query) query_id, query, pos, neg from (select conv_id row_id, arg_min(text, turn) filter (role = 'user') query,
        list({'docid': md5(text), 'text': text} order by turn) filter (role = 'assistant') pos, list({'docid': md5(text), 'text': text} order by turn) filter (role <> 'assistant') neg from conversations group by conv_id) where query is not null""",
    "lasts": "select *, min(row_id) over (partition by query_id) q_ord from training qualify row_number() over (partition by query_id order by row_id desc) = 1",
    "cparts": "select p_partkey k, p_partkey::varchar doc_id, 'See ' || p_size || ' U.S.C. § ' || (p_partkey % 97) || ' and ' || (p_partkey % 89) || ' F.2d ' || (p_partkey % 13) || '; Doe v. Roe § ' || (p_partkey % 7) \"text\" from part",
    "csup": "select s_suppkey q_ord, s_suppkey::varchar query_id, case when s_suppkey % 5 = 0 then 'what is this' else 'Is ' || (s_suppkey % 89) || ' F.2d ' || (s_suppkey % 13) || ' good law under § ' || (s_suppkey % 7) end query from supplier",
    "cgold": "select query_id, q_ord::varchar doc_id from csup where q_ord in (select p_partkey from part)",
    "cneg": "select query_id, k::varchar doc_id from (select query_id, unnest(range(q_ord + 1, q_ord + 21)) k from csup) where k in (select p_partkey from part)",
    "cpool": "select query_id, doc_id, max(gold) gold from (select query_id, doc_id, 1 gold from cgold union all select query_id, doc_id, 0 from cneg) where query_id in (select query_id from cneg) group by all",
    "csize": "select query_id, count(*) pool_size from (select query_id, doc_id from cgold union all select query_id, doc_id from cneg) where query_id in (select query_id from cneg) group by all",
    "npool": "select query_id, doc_id, max(gold) gold from (select query_id, doc_id, 1 gold from qrels union all select query_id, doc_id, 0 from neg) where query_id in (select query_id from neg) group by all",
    "nsize": "select query_id, count(*) pool_size from (select query_id, doc_id from qrels union all select query_id, doc_id from neg) where query_id in (select query_id from neg) group by all",
    "nscored": "select query_id, doc_id, gold, round(coalesce(score, 0), 6) s, 1 n from npool left join bm1 using (query_id, doc_id) union all select query_id, doc_id, gold, round(coalesce(score, 0), 6), 2 from npool left join bm2 using (query_id, doc_id)",
    "nranks": "select query_id, n, sum((s > best)::int) + 1 + (sum((s = best)::int) - 1) / 2.0 rank, max(best) = 0 zero from (select *, max(s) filter (gold = 1) over (partition by query_id, n) best from nscored) group by all",
    "nrows": "select r.*, z.pool_size, regexp_matches(q.query, '[\"“”]') quoted from nranks r join nsize z using (query_id) join queries q using (query_id)",
}


def _entities(table: str, key: str, text: str) -> str:
    parts = []
    for kind, pattern in ENTITY_PATTERNS.items():
        p = pattern.removeprefix("(?U)").replace("'", "''")
        parts.append(f"select {key}, unnest(list_transform(regexp_extract_all({text}, '{p}'), lambda m: '{kind}:' || regexp_replace(lower(trim(m)), '\\s+', ' ', 'g'))) entity from {table}")
    return "select distinct * from (" + " union all ".join(parts) + ")"


TABLES["cpe"] = _entities("cparts", "doc_id", "text")
TABLES["cqe"] = _entities("csup", "query_id", "query")
TABLES["cshared"] = "select query_id, doc_id, entity from cpool join cqe using (query_id) join cpe using (doc_id, entity)"


def _metrics_sql(run: str, qrels: str, metrics: tuple[str, ...]) -> str:
    """query_id, metric, value with linear gain."""
    ideal = f"select query_id, grade, row_number() over (partition by query_id order by grade desc, doc_id) i from {qrels}"
    judged = f"select query_id, rank, grade, sum((grade >= 1)::int) over (partition by query_id order by rank) nth from {run} join {qrels} using (query_id, doc_id)"
    out = []
    for m in metrics:
        name, k = m.split("@")
        found = f"coalesce((select sum((rank <= {k})::int) from ({judged}) h where h.query_id = q.query_id and grade >= 1), 0)"
        value = {
            "ndcg": f"coalesce((select sum(grade / log2(rank + 1)) from ({judged}) h where h.query_id = q.query_id and rank <= {k}), 0) / (select sum(grade / log2(i + 1)) from ({ideal}) x where x.query_id = q.query_id and i <= {k})",
            "recall": f"{found} / (select count(*) from {qrels} x where x.query_id = q.query_id)::double",
            "mrr": f"coalesce((select max(1.0 / rank) from ({judged}) h where h.query_id = q.query_id and grade >= 1 and rank <= {k}), 0)::double",
            "map": f"coalesce((select sum(nth / rank::double) from ({judged}) h where h.query_id = q.query_id and grade >= 1 and rank <= {k}), 0) / (select count(*) from {qrels} x where x.query_id = q.query_id)",
            "precision": f"{found} / {k}::double",
            "hits": f"{found}::double",
        }[name]
        out.append(f"select query_id, '{m}' metric, ({value})::double value from (select distinct query_id from {qrels}) q")
    return " union all ".join(out)


TABLES["m_words"] = _metrics_sql("run1", "qrels", _METRICS)
TABLES["m_pairs"] = _metrics_sql("run2", "qrels", _METRICS)
TABLES["m_tf"] = _metrics_sql("run_tf", "qrels", _METRICS)
TABLES["prs"] = "select query_id, metric, a.value a, b.value b, b.value - a.value d from m_tf a join m_words b using (query_id, metric)"
TABLES["numbered"] = "select metric, d, row_number() over (partition by metric order by query_id) - 1 i, count(*) over (partition by metric) n from prs"


def sql(select: str) -> str:
    """The select with every common table that it stands on, directly or not, in order."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"(?:\bfrom|\bjoin|,)\s+{name}\b", text):
                need(TABLES[name])
                needed.append(name)

    need(select)
    head = ", ".join(f"{n} as materialized ({TABLES[n]})" for n in needed)
    return f"with {head} {select}" if needed else select


_HITS = "query_id, doc_id, round(score, 6) score, rank::integer rank"


def _top(source: str, k: int) -> str:
    return f"select {_HITS} from (select *, {_BEST} rank from {source}) where rank <= {k}"


def _cut(text: str) -> str:
    return f"select {_HITS} from ({text})"


def _share(condition: str) -> str:
    return f"avg(({condition})::int)"


def _hash(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::bigint"


def _one_metric(metric: str) -> str:
    return f"select query_id, round(value, 6) value from ({_metrics_sql('run_tf', 'qrels', (metric,))})"


_DEDUPED = "select query_id, doc_id, score, row_number() over (partition by query_id order by rank) rank from (select h.*, row_number() over (partition by query_id, did order by h.rank) first from ({0}) h join pid2did using (doc_id)) where first = 1"
_BM1_50 = f"select *, {_BEST} rank from bm1 qualify rank <= 50"
_BM2_50 = f"select *, {_BEST} rank from bm2 qualify rank <= 50"
_BM2_POOL = "select p.query_id, p.doc_id, coalesce(b.score, 0) score, in_rank, row_number() over (partition by p.query_id order by round(coalesce(b.score, 0), 6) desc, in_rank) rank from pool p left join bm2 b using (query_id, doc_id)"
_EXPANDED = """select query_id, doc_id, row_number() over (partition by query_id order by rank, sibling, doc_id) rank from (select query_id, doc_id, rank, sibling, row_number() over (partition by query_id, doc_id order by sibling, rank) one from
    (select h.query_id, s.doc_id, h.in_rank rank, (s.doc_id <> h.doc_id)::int sibling from pool h join pid2did p using (doc_id) join pid2did s on s.did = p.did)) where one = 1"""
_HEAD = "select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) rank from head_hits"

ORACLE = {
    "ingest_corpus": "select docid doc_id, arg_min(x.text, pos) \"text\" from (select p.docid docid, p as x, row_id * 1000000 + unnest(range(len(ps))) pos from (select row_id, ps, unnest(ps) p from (select row_id, list_concat(coalesce(pos, []), coalesce(neg, [])) ps from training))) group by docid",
    "ingest_queries": "select query_id, query, q_ord from lasts",
    "ingest_qrels": "select distinct query_id, p.docid doc_id, 1::integer grade from (select query_id, unnest(pos) p from lasts)",
    "ingest_negatives": "select distinct query_id, p.docid doc_id from (select query_id, unnest(neg) p from lasts)",
    "passage_scan": "select doc_id, did, md5(text) text_md5 from passages",
    "pid2did_scan": "select doc_id, did from pid2did where doc_id in (select doc_id from qrels)",
    "sample_pair": "select query_id, doc_id from qrels order by md5('42:' || query_id || ':' || doc_id) limit 1",
    "embed_cache_roundtrip": "select vec_id::varchar item_id, len(embedding)::integer size, round(embedding[1]::double, 6) \"first\" from embeddings",
    "embed_cache_fill": "select item_id::varchar item_id, case when item_id % 2 = 0 then -1.0 else length(text) end::double \"value\" from benchmark",
    "upsert_skip_existing": "select doc_id id, lang from documents where lang <> 'en'",
    "upsert_latest": "select user_id id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "backfill_slot": "select c_custkey id, round(c_acctbal, 2) balance, round(s, 2) spent from customer left join (select o_custkey, sum(o_totalprice) s from orders group by o_custkey) on o_custkey = c_custkey",
    "points_count": "select count(*) n from passages",
    "warmup_missing": "select distinct text query from conversations where role = 'user' and text not in (select text from conversations where role = 'user' and turn = 0)",
    "tokenize": f"select doc_id, array_to_string({_TOKENS.format('text')}, ' ') tokens from documents",
    "ngrams": f"select doc_id, array_to_string(list_concat(t, {_BIGRAMS}), ' ') grams from (select doc_id, {_TOKENS.format('text')} t from documents)",
    "term_freq": f"select doc_id, gram, count(*) tf from (select doc_id, unnest({_TOKENS.format('text')}) gram from documents) group by all",
    "ngram_df": "select gram, df from df",
    "ngram_idf": "select gram, n::integer n, coalesce(df, 0) df, round(coalesce(idf.idf, (select ln(1 + (n_docs + 0.5) / 0.5) from cst)), 6) idf from (select distinct gram, n from qgram) left join df using (gram) left join idf using (gram)",
    "quoted_flag": "select doc_id, regexp_matches(text, '[\"“”]') quoted from documents",
    "entities": "select doc_id, entity from cpe",
    "word_counts": "select doc_id, len(regexp_extract_all(text, '[^\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'))::bigint words from documents",
    "sparse_encode_docs": "select doc_id, count(*) n, round(sum(val), 6) total, round(max(val), 6) largest from enc_idx group by doc_id",
    "sparse_encode_query": "select query_id, gram, 1.0::double val from qgram",
    "bm25_unigram": _top("bm1", 10),
    "stored_index_topk": _top("bm2", 10),
    "bm25_bigram": _top("bm2", 10),
    "dense_topk": _top(f"({_dense('', 'list_dot_product(q.e, d.e) / (q.norm * d.norm)')})", 10),
    "dense_topk_dot": _top(f"({_dense('', 'list_dot_product(q.e, d.e)')})", 10),
    "dense_topk_l2": _top(f"({_dense('', '0 - list_distance(q.e, d.e)')})", 10),
    "dense_topk_l1": _top(f"({_dense('', '0 - list_sum(list_transform(range(1, len(q.e) + 1), lambda i: abs(q.e[i] - d.e[i])))')})", 10),
    "sparse_topk": _top("sparse", 10),
    "hybrid_rrf": _top("(select query_id, doc_id, sum(1.0::double / (1 + rank)) score from fusable group by all)", 10),
    "hybrid_dbsf": _top("(select query_id, doc_id, sum(case when d > 0 then (score - (m - 3 * d)) / (6 * d) else 0.5 end) score from (select *, avg(score) over (partition by query_id, arm) m, stddev_samp(score) over (partition by query_id, arm) d from fusable) group by all)", 10),
    "hybrid_rerank_maxsim": _top(
        "(select query_id, doc_id, score from maxsim where (query_id, doc_id) in (select query_id, doc_id from (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) pr from (select query_id, doc_id, sum(1.0::double / (1 + rank)) score from ("
        f"select *, {_BEST} rank from head_hits qualify rank <= 500 union all select *, {_BEST} rank from tail_hits qualify rank <= 500) group by all)) where pr <= 100))",
        10,
    ),
    "maxsim_topk": _top("maxsim", 10),
    "dedupe_by_doc": _cut("select * from (" + _DEDUPED.format(_BM1_50) + ") where rank <= 10"),
    "unique_doc_topk": _cut("select * from (" + _DEDUPED.format(_BM2_50) + ") where rank <= 10"),
    "rerank_pairwise": _cut(
        "select *, row_number() over (partition by query_id order by round(score, 6) desc, in_rank) rank from (select p.query_id, p.doc_id, in_rank, len(list_intersect(list_distinct(q.t), d.t)) / greatest(len(list_distinct(q.t)), 1)::double score from pool p join qtok q using (query_id) join ptok d using (doc_id)) qualify rank <= 10"
    ),
    "rerank_maxsim": _cut(f"select h.query_id, h.doc_id, x.score, row_number() over (partition by h.query_id order by round(x.score, 6) desc, h.rank) rank from ({_HEAD} qualify rank <= 100) h join maxsim x using (query_id, doc_id) qualify row_number() over (partition by h.query_id order by round(x.score, 6) desc, h.rank) <= 10"),
    "rerank_filtered_maxsim": _cut(
        f"select * from (select h.query_id, h.doc_id, coalesce(x.score, h.score) score, row_number() over (partition by h.query_id order by (x.score is null)::int, round(x.score, 6) desc, h.rank) rank from ({_HEAD} qualify rank <= 100) h left join (select * from maxsim where doc_id in (select doc_id from mv where vecs[1][1] > 0.1875)) x using (query_id, doc_id)) where rank <= 10"
    ),
    "rerank_ngram_bm25": _cut(f"select * from ({_BM2_POOL}) where rank <= 10"),
    "rerank_fused_ngram": _cut(f"select query_id, doc_id, f score, row_number() over (partition by query_id order by round(f, 12) desc, in_rank) rank from (select query_id, doc_id, in_rank, 1.0::double / (60 + in_rank) + 1.0::double / (60 + rank) f from ({_BM2_POOL})) qualify rank <= 10"),
    "rerank_sibling_expansion": _cut(
        "select * from (" + _DEDUPED.format(f"select e.query_id, e.doc_id, coalesce(b.score, 0) score, row_number() over (partition by e.query_id order by round(coalesce(b.score, 0), 6) desc, e.rank) rank from ({_EXPANDED}) e left join bm2 b using (query_id, doc_id)") + ") where rank <= 10"
    ),
    "build_run": _cut("select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) rank from (" + _DEDUPED.format(_BM1_50) + ")"),
    "eval_binary": "select metric, round(avg(value), 6) \"value\", count(*) n_queries from m_words group by metric",
    "running_metric": "select metric, q_ord, round(avg(value) over (partition by metric order by q_ord), 6) \"value\" from m_tf join queries using (query_id) where metric in ('ndcg@10', 'mrr@10')",
    "sibling_qrels": "select query_id, doc_id, grade from sibq",
    "eval_graded": f"select metric, round(avg(value), 6) \"value\", count(*) n_queries from ({_metrics_sql('run1', 'sibq', _METRICS)}) group by metric",
    "doc_level_diagnosis": f"""select count(*) n_queries, round({_share('gold = 1')}, 6) exact_pct, round({_share('coalesce(gold, 0) = 0 and same = 1')}, 6) sibling_only_pct, round({_share('coalesce(gold, 0) = 0 and coalesce(same, 0) = 0')}, 6) miss_pct, round(avg(coalesce(prec, 0)), 6) mean_doc_precision
        from (select distinct query_id from qrels) left join (select h.query_id, max((g.doc_id is not null)::int) gold, max((d.did is not null)::int) same, avg((d.did is not null)::int) prec from run1 h join pid2did p using (doc_id)
        left join (select distinct q.query_id, p.did from qrels q join pid2did p using (doc_id)) d on d.query_id = h.query_id and d.did = p.did left join qrels g on g.query_id = h.query_id and g.doc_id = h.doc_id where h.rank <= 10 group by h.query_id) using (query_id)""",
    "pairwise_stats": f"select *, round(1 - win - loss, 6) tie from (select metric, count(*) n, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, round(avg(d), 6) delta, round({_share('b > a')}, 6) win, round({_share('b < a')}, 6) loss from prs group by metric)",
    "bootstrap_ci": f"select metric, round(quantile_cont(m, 0.025), 6) ci_low, round(quantile_cont(m, 0.975), 6) ci_high from (select x.metric, x.r, avg(y.d) m from (select metric, r, {_hash(chr(39) + '42' + chr(39), 'r', 'i')} % n i from numbered, range({RESAMPLES}) t(r)) x join numbered y using (metric, i) group by all) group by metric",
    "permutation_p": f"select metric, round((sum((round(m, 9) >= round(o, 9))::int) + 1) / (count(*) + 1), 6) p from (select metric, r, abs(avg(case when {_hash(chr(39) + '42' + chr(39), chr(39) + 'flip' + chr(39), 'r', 'i')} % 2 = 0 then d else -d end)) m from numbered, range({RESAMPLES}) t(r) group by all) join (select metric, abs(avg(d)) o from numbered group by metric) using (metric) group by metric",
    "wilcoxon_z": """select metric, coalesce(n, 0) n, round(coalesce(tp, 0), 6) t_plus, round(coalesce(tm, 0), 6) t_minus, round((least(tp, tm) - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0), 0), 6) z from (select distinct metric from prs) left join (
        select metric, count(*) n, sum(case when d > 0 then r else 0 end)::double tp, sum(case when d < 0 then r else 0 end)::double tm, sum(t * t - 1)::double tt from (select metric, d, count(*) over (partition by metric, size) t, rank() over (partition by metric order by size) + (count(*) over (partition by metric, size) - 1) / 2.0 r
        from (select metric, d, round(abs(d), 9) size from prs) where size > 0) group by metric) using (metric)""",
    "compare_all_pairs": f"""select metric, run_a, run_b, round(avg(d), 6) delta, round({_share('d > 0')}, 6) win, round({_share('d < 0')}, 6) loss, round(case when round(stddev_samp(d) / sqrt(count(*)), 9) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) end, 6) t
        from (select x.metric, x.run run_a, y.run run_b, y.value - x.value d from allm x join allm y using (query_id, metric) where x.run < y.run) group by all""",
    "fisher_p": f"""select metric, run_a, run_b, p, p <= 0.05 significant from (select metric, run_a, run_b, round((sum((round(m, 9) >= round(o, 9))::int) + 1) / (count(*) + 1), 6) p from (
        select metric, run_a, run_b, r, abs(avg(case when {_hash(chr(39) + '42' + chr(39), chr(39) + 'flip' + chr(39), 'r', 'i')} % 2 = 0 then d else -d end)) m from twos, range({RESAMPLES}) t(r) group by all)
        join (select metric, run_a, run_b, abs(avg(d)) o from twos group by all) using (metric, run_a, run_b) group by all)""",
    "corpus_stats": f"""select count(*) n_docs, sum(len)::bigint total, round(avg(len), 6) mean, max(len)::bigint max, {', '.join(f"floor(quantile_cont(len, {q / 100}))::bigint p{q}" for q in (50, 90, 95, 99))}, round({_share('len > 512')}, 6) pct_over_max, {', '.join(f"round({_share(f'len > {t}')}, 6) pct_over_{t}" for t in (128, 256, 512, 1024, 2048))}, round(sum(greatest(len - 512, 0)) / sum(len), 6) truncation_loss
        from (select len({_TOKENS.format('text')}) len from documents)""",
    "needs_chunking": f"select {_share('len > 512')} > 0.1 or sum(greatest(len - 512, 0)) / sum(len) > 0.1 needs_chunking from (select len({_TOKENS.format('text')}) len from documents)",
    "word_stats": "select count(*) n, round(avg(w), 6) mean, round(median(w), 6) median, round(stddev_pop(w), 6) std, max(w)::bigint max, round(avg((w = (select max(w) from wc))::int), 6) share_at_max from wc",
    "did_to_pids": "select did, string_agg(doc_id, ',' order by doc_id) pids from pid2did group by did",
    "pid_did_orphans": "select doc_id from pid2did where did in (select doc_id::varchar from documents where lang = 'fr')",
    "sibling_pairs": "select query_id, doc_id from sib",
    "sibling_stats": """select (select count(distinct did) from pid2did) n_docs, (select count(*) from (select did from pid2did group by did having count(*) > 1)) multi_docs, (select max(n) from (select count(*) n from pid2did group by did)) max_passages,
        (select count(distinct query_id) from qrels) n_queries, (select count(distinct query_id) from sib) queries_with_siblings, (select count(*) from sib) siblings, (select count(distinct query_id) from neg join sib using (query_id, doc_id)) queries_with_sibling_negatives, (select count(*) from neg join sib using (query_id, doc_id)) sibling_negatives""",
    "sibling_examples": "select query_id, q_ord, (select string_agg(doc_id, ',' order by doc_id) from qrels g where g.query_id = x.query_id) gold, siblings from (select query_id, string_agg(doc_id, ',' order by doc_id) siblings from sib group by query_id) x join queries using (query_id) order by q_ord limit 5",
    "sibling_example": "select did, n from (select did, count(*) n from pid2did group by did) order by n desc, did desc limit 1",
    "entity_overlap": "select query_id, doc_id, entity from cshared",
    "entity_signal": """select num_queries, median_entities_per_query, queries_with_entities, median_pool_size, gold_zero_overlap_pct, mean_relative_rank, random_top1_pct, gold_top_1_pct, gold_top_3_pct, gold_top_5_pct from
        (select count(*) num_queries, floor(median(n))::bigint median_entities_per_query from (select query_id, count(entity) n from (select distinct query_id from cpool) left join cqe using (query_id) group by query_id)),
        (select count(*) queries_with_entities, floor(median(pool_size))::bigint median_pool_size, round(avg(zero::int), 6) gold_zero_overlap_pct, round(avg(rank / pool_size), 6) mean_relative_rank, round(avg(1.0::double / pool_size), 6) random_top1_pct, round(avg((rank <= 1)::int), 6) gold_top_1_pct, round(avg((rank <= 3)::int), 6) gold_top_3_pct, round(avg((rank <= 5)::int), 6) gold_top_5_pct
        from (select query_id, sum((s > best)::int) + 1 + (sum((s = best)::int) - 1) / 2.0 rank, max(best) = 0 zero from (select *, max(s) filter (gold = 1) over (partition by query_id) best from (select p.query_id, p.doc_id, p.gold, round(coalesce(sum(w), 0), 6) s from (select * from cpool where query_id in (select query_id from cqe)) p
        left join (select query_id, doc_id, 1.0::double / count(*) over (partition by query_id, entity) w from cshared) c using (query_id, doc_id) group by all)) group by query_id) join csize using (query_id))""",
    "ngram_signal": f"""select case when n = 1 then 'unigram' else 'uni+' || n || 'gram' end arm, stratum, count(*) num_queries, round(avg(rank / pool_size), 6) mean_relative_rank, round({_share('rank <= 1')}, 6) gold_top_1_pct, round({_share('rank <= 3')}, 6) gold_top_3_pct, round({_share('rank <= 5')}, 6) gold_top_5_pct, round({_share('zero')}, 6) gold_zero_overlap_pct
        from (select *, unnest(['all', case when quoted then 'quoted' else 'unquoted' end]) stratum from nrows) group by all""",
    "ngram_arm_deltas": "select n::integer n, round(m, 6) mean_relative_rank, round(m - lag(m) over (order by n), 6) delta from (select n, avg(rank / pool_size) m from nrows group by n)",
    "rag_prompt": f"""select query_id, md5(prompt) prompt_md5, length(prompt) chars, retrieved from (select q.query_id, '{QUESTION_PREFIX}' || q.query || chr(10) || chr(10) || '{EXCERPTS_HEADING}' || chr(10) || string_agg('[doc_id: ' || h.doc_id || ']' || chr(10) || p.text, chr(10) || chr(10) order by h.rank) || chr(10) || chr(10) || '{CLOSING}' prompt,
        string_agg(h.doc_id, ',' order by h.rank) retrieved from run2 h join passages p using (doc_id) join queries q using (query_id) where h.rank <= {TOP_K} group by q.query_id, q.query)""",
}
for _n in ("ndcg", "recall", "mrr"):
    for _k in (10, 100):
        ORACLE[f"{_n}_at_{_k}"] = _one_metric(f"{_n}@{_k}")
for _n in ("map", "precision", "hits"):
    ORACLE[f"{_n}_at_10"] = _one_metric(f"{_n}@10")
TABLES["allm"] = "select 'words' run, * from m_words union all select 'pairs' run, * from m_pairs union all select 'tf' run, * from m_tf"
TABLES["twos"] = "select x.metric, x.run run_a, y.run run_b, y.value - x.value d, row_number() over (partition by x.metric, x.run, y.run order by x.query_id) - 1 i from allm x join allm y using (query_id, metric) where x.run < y.run"
TABLES["wc"] = f"select words w from ({ORACLE['word_counts']})"

ORACLE = {k: sql(v) for k, v in ORACLE.items()}
