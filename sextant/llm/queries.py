"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import expand_prefix_targets, read_back
from .decontam import find_contamination
from .dedup import near_duplicates
from .huffman import encode_documents
from .infill import fill_in_middle, infill_digests
from .langid import language_of
from .lexical import build_index
from .packing import pack_documents
from .pages import extract_main_text
from .pii import find_personal_data
from .quality import quality_rules
from .secrets import find_secrets
from .sharding import shard_documents
from .stages import table
from .tokens import vocabulary_path

TOKEN_FILE_VOCABULARY = "word_bpe_49k.json"
PACKING_VOCABULARY = "word_bpe_49k.json"


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(expand_prefix_targets(turns))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(TOKEN_FILE_VOCABULARY))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(PACKING_VOCABULARY))


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"), 20)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_digests(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_prefix_targets, op2_near_duplicates, op3_disclosure_pii, op4_quality_trees, op5_crf_main_text, op6_jump_sharding, op7_huffman_token_files,
        op8_decontamination, op9_harmonic_packing, op10_markov_secrets, op11_ranked_lexical_search, op12_fill_in_middle, op13_hyperdimensional_language,
    )
}

_SPACE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op1_chat_prefix_targets": r"""
        with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
                   union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        h as (select *, '<|' || replace(replace(replace(r, '\', '\\'), '<|', '<\|'), '|>', '|\>') || '|>' || chr(10) head, replace(replace(t, '\', '\\'), '<|', '<\|') body from c),
        s as (select *, head || body || '<|end|>' || chr(10) f from h),
        p as (select *, sum(length(f)) over w upto, string_agg(f, '') over w prefix, sum((r = 'assistant')::int) over w - 1 e from s window w as (partition by conv_id order by turn, r rows unbounded preceding)),
        x as (select *, upto - length(f) + length(head) lo from p)
        select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn)) turns_sha256, coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
            sha256(coalesce(string_agg(t, '' order by turn) filter (r = 'assistant'), '')) loss_sha256, sum(length(f))::bigint formatted_chars, count(*) filter (r = 'assistant') n_examples, coalesce(sum(upto) filter (r = 'assistant'), 0)::bigint rendered_chars,
            sha256(coalesce(string_agg(e || ':' || upto || ':' || lo || ':' || lo + length(body) || ':' || sha256(prefix) || chr(10), '' order by e) filter (r = 'assistant'), '')) examples_sha256
        from x group by conv_id""",
    "op2_near_duplicates": f"""
        with recursive w as (select doc_id, {_SPACE_WORDS} w from documents),
        g as materialized (select distinct doc_id, g from (select doc_id, unnest(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) g from w)),
        n as (select doc_id, count(*) n from g group by doc_id),
        e as materialized (select x.doc_id a, y.doc_id b from g x join g y using (g) join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
            where x.doc_id <> y.doc_id and nx.n * 100 >= ny.n * 80 and ny.n * 100 >= nx.n * 80 group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
        r(a, label) as (select distinct a, a from e union select e.b, r.label from r join e using (a)),
        l as (select a, min(label) label from r group by a)
        select doc_id, coalesce(n.n, 0) n_shingles, coalesce(l.label, doc_id) component_id, coalesce(l.label, doc_id) = doc_id kept from documents left join n using (doc_id) left join l on l.a = doc_id""",
    "op6_jump_sharding": """
        with recursive d as (select doc_id, coalesce(text, '') t, octet_length(encode(coalesce(text, ''))) + 1 size from documents),
        steps as (select list_transform(range(256), lambda n: list_reduce(list_concat([n::ubigint], list_transform(range(8), lambda i: 0::ubigint)), lambda c, i: case when c % 2 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end)) tab),
        texts as (select distinct t, hex(encode(t)) h from d),
        crc as (select t, xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::ubigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255::ubigint)::int + 1]))) crc from texts, steps),
        k0 as (select distinct doc_id, case when doc_id is null then 9223372036854775808::ubigint when doc_id >= 0 then doc_id::ubigint else (doc_id::hugeint + 18446744073709551616)::ubigint end x from d),
        k1 as (select doc_id, xor(x, x >> 30) x from k0),
        k2 as (select doc_id, ((x::uhugeint * 13787848793156543929::uhugeint) % 18446744073709551616::uhugeint)::ubigint x from k1),
        k3 as (select doc_id, xor(x, x >> 27) x from k2),
        k4 as (select doc_id, ((x::uhugeint * 10723151780598845931::uhugeint) % 18446744073709551616::uhugeint)::ubigint x from k3),
        k5 as (select doc_id, xor(x, x >> 31) x from k4),
        jump(x, key, b, j) as (select distinct x, x, -1::bigint, 0::bigint from k5 union all
          select x, key2, j, floor((j + 1) * (2147483648.0::double / ((key2 >> 33)::double + 1)))::bigint from (select x, j, ((key::uhugeint * 2862933555777941757::uhugeint + 1::uhugeint) % 18446744073709551616::uhugeint)::ubigint key2 from jump where j < 17)),
        s as (select x, max(b) filter (b < 16) shard, max(b) filter (b < 17) grown from jump group by x),
        r0 as (select d.doc_id, d.size, crc.crc, s.shard, s.grown, ((k5.x::uhugeint + crc.crc::uhugeint * 2654435761::uhugeint + d.size::uhugeint) % 18446744073709551616::uhugeint)::ubigint x from d join crc using (t) join k5 on k5.doc_id is not distinct from d.doc_id join s on s.x = k5.x),
        r1 as (select * replace (xor(x, x >> 30) as x) from r0),
        r2 as (select * replace (((x::uhugeint * 13787848793156543929::uhugeint) % 18446744073709551616::uhugeint)::ubigint as x) from r1),
        r3 as (select * replace (xor(x, x >> 27) as x) from r2),
        r4 as (select * replace (((x::uhugeint * 10723151780598845931::uhugeint) % 18446744073709551616::uhugeint)::ubigint as x) from r3),
        r5 as (select * replace (xor(xor(x, x >> 31), 9223372036854775808::ubigint) as x) from r4)
        select doc_id, size::bigint size, crc::bigint text_crc32, 'key' law, shard::integer shard, (row_number() over (partition by shard order by x, doc_id, size, crc) - 1)::bigint slot, grown::integer grown_shard from r5""",
    "op8_decontamination": f"""
        with b as (select item_id, {_ALNUM_WORDS} w from benchmark),
        bw as materialized (select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
        d as materialized (select doc_id, {_ALNUM_WORDS} w from documents),
        dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw))),
        h as materialized (select doc_id, i, n, item_id from dw join bw using (n, g)),
        k as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from h) group by doc_id),
        m as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) s from (select distinct doc_id, item_id::varchar x from h) group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join k using (doc_id) left join m using (doc_id)""",
    "op11_ranked_lexical_search": f"""
        with d as materialized (select row_number() over () r, doc_id, {_ALNUM_WORDS} w from documents),
        s as (select count(*) n, sum(len(w))::bigint l from d where len(w) > 0),
        p as materialized (select r, t, count(*) tf from (select r, unnest(w) t from d) group by r, t),
        q as materialized (select item_id, t, count(*) c from (select item_id, unnest({_ALNUM_WORDS}) t from benchmark) group by item_id, t),
        f as (select t, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint w from (select t, count(*) df from p where t in (select t from q) group by t), s),
        x as (select item_id, r, sum(c * f.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * n) // l))))::bigint score from q join f using (t) join p using (t) join d using (r), s group by item_id, r),
        o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) rank, doc_id, score from x join d using (r) where score > 0)
        select item_id, rank::integer rank, doc_id, score from o where rank <= 20""",
    "op12_fill_in_middle": """
        with x as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(doc_id::varchar, '')) s from documents),
        h as (select *, ('0x' || s[1:8])::bigint h1, ('0x' || s[9:16])::bigint h2, ('0x' || s[17:24])::bigint h3, ('0x' || s[25:32])::bigint h4 from x),
        c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
            case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from h),
        p as (select *, substr(t, 1, a) p, substr(t, a + 1, b - a) m, substr(t, b + 1) s3 from c)
        select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s3 || '<M>' || m else '<S>' || s3 || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from p""",
}
