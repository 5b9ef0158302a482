"""The registered queries of the training-data operators, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, fim, langid, linededup, lsm, merkle, mixing, pii, rabitq, secrets, simhash
from .common import table

#: Place of the vocabulary; a parameter of the operator.
WORD_BPE = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.similar(spark, table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"), vocabulary_path())


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = chat.streamed_events(chat.with_probe(spark, table(spark, sf_dir, "conversations")))
    return chat.digests(chat.format_conversations(events))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(spark, table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "row.source", F.col("copy_no").cast("long").alias("copy_no"), F.col("n_copies").cast("long").alias("n_copies"), "mix_order", "row.text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.exact_groups(spark, table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.dictionaries(docs.where(~held_out()))
    return langid.classify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_dedup(spark, table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_points"), F.sha2("text", 256).alias("text_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_embedding_near_dedup, op3_bpe, op4_chat_format, op5_source_mix, op6_exact_dedup, op7_language_id, op8_simhash_near_dedup, op9_line_dedup, op10_personal_data, op11_nearest_neighbours, op12_fill_in_middle, op13_merkle_manifest, pipeline)}

ORACLES = {
    "op2_embedding_near_dedup": """
        with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
        r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
        c as (select a, min(b) m from r group by a), n as (select a, count(*) n from p group by a)
        select e.vec_id, coalesce(n.n, 0)::bigint n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) component_id, e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) kept
        from embeddings e left join c on c.a = e.vec_id left join n on n.a = e.vec_id""",
    "op4_chat_format": r"""
        with c as (select conv_id, turn, role, text from conversations union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from c),
        g as (select conv_id, count(*) n_turns, string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x) said, coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn, r, x), '') loss,
            sum(12 + length(url_encode(r)) + 1 + length(x) + length(x) - length(replace(x, chr(92), '')) + len(regexp_extract_all(x, '<\||</?s>|\[/?INST\]')) + 10 + 1) chars from t group by conv_id)
        select conv_id, n_turns::bigint n_turns, sha256(said) turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, chars::bigint formatted_chars from g""",
    "op5_source_mix": """
        with n as (select source, count(*) n, pow(count(*)::double, 0.5) w from documents group by source),
        r as (select source s, (sum(n) over ()) * w / (sum(w) over ()) / n rate from n),
        d as (select d.doc_id, d.source, d.text, r.rate, ceil(r.rate)::int parts, coalesce(d.doc_id::varchar, 'null') k from documents d join r on d.source is not distinct from r.s),
        u as (select doc_id, source, text, rate / parts mean, unnest(range(1, parts + 1)) j, k from d),
        x as (select doc_id, source, text, k, mean, ('0x' || substr(md5('7|' || k || '|' || j), 1, 13))::bigint / 4503599627370496.0 u from u),
        y as (select doc_id, source, text, k, list_sum(list_transform(range(0, 21), lambda q: case when list_sum(list_transform(range(0, q + 1), lambda z: exp(-mean) * pow(mean, z) / factorial(z::int)::double)) < u then 1 else 0 end)) n from x),
        g as (select doc_id, source, text, k, sum(n)::bigint n_copies from y group by all),
        e as (select *, unnest(range(1, n_copies + 1)) copy_no from g)
        select doc_id, source, copy_no, n_copies, md5('order|7|' || k || '|' || copy_no) mix_order, text from e""",
    "op6_exact_dedup": r"""
        with n as (select doc_id, length(coalesce(text, '')) p, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h from documents),
        g as (select doc_id, first_value(doc_id) over (partition by h order by p desc, doc_id) keep_id, count(*) over (partition by h) group_size, h from n)
        select doc_id, keep_id, group_size, doc_id = keep_id kept, h text_sha256 from g""",
    "op9_line_dedup": r"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) a from documents),
        l as (select doc_id, unnest(a) x, unnest(range(1, len(a) + 1)) i, len(a) n from d),
        m as (select *, ('0x' || substr(md5(x), 1, 7))::bigint h, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) words from l),
        w as (select *, coalesce(lag(h) over o, 0) ph, lead(x) over o nx, lead(words) over o nw from m window o as (partition by doc_id order by i)),
        k as (select *, coalesce(sum((i = n or (31 * ph + h) % 1000003 % 3 = 0)::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) no from w),
        c as (select doc_id, min(i) i, string_agg(x, chr(10) order by i) t from k group by doc_id, no having count(*) > 1 and sum(words) > 0),
        u as (select 'c' kind, doc_id, i, t from c union all select 'p', doc_id, i, x || chr(10) || nx from w where i < n union all select 'l', doc_id, i, x from w where words > 50),
        g as (select kind, doc_id, i from u qualify row_number() over (partition by kind, t order by doc_id, i) > 1),
        p as (select g.doc_id, g.i, w.words, w.nw, g.i - row_number() over (partition by g.doc_id order by g.i) run, c.i is not null chunk from g join w on w.doc_id = g.doc_id and w.i = g.i left join g c on c.kind = 'c' and c.doc_id = g.doc_id and c.i = g.i where g.kind = 'p'),
        r as (select doc_id, min(i) a, max(i) + 1 b from p group by doc_id, run having bool_or(chunk) or sum(words) + arg_max(nw, i) > 50 union all select doc_id, i, i from g where kind = 'l'),
        gone as (select distinct doc_id, unnest(range(a, b + 1)) i from r),
        f as (select l.*, gone.i is not null gone from l left join gone using (doc_id, i))
        select doc_id, count(*)::bigint n_lines, sum(gone::int)::bigint n_removed, length(coalesce(string_agg(case when not gone then x end, chr(10) order by i), ''))::bigint n_points,
            sha256(coalesce(string_agg(case when not gone then x end, chr(10) order by i), '')) text_sha256 from f group by doc_id""",
    "op12_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || coalesce(doc_id::varchar, 'null')) h from documents),
        x as (select *, len(u) n, ('0x' || h[1:8])::bigint % (len(u) + 1) p, ('0x' || h[9:16])::bigint % (len(u) + 1) q, ('0x' || h[25:32])::bigint % 100 < 50 spm from d),
        y as (select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when spm then 'spm' else 'psm' end form,
            array_to_string(u[1:least(p, q)], '') a, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') b, array_to_string(u[greatest(p, q) + 1:n], '') c from x)
        select doc_id, n::bigint n, form, case when form <> 'plain' then length(a)::bigint end prefix_chars, case when form <> 'plain' then length(b)::bigint end middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) output_sha256, sha256(t) restored_sha256 from y""",
    "op13_merkle_manifest": r"""
        with recursive d as (select row_number() over (order by source nulls first, doc_id nulls first) row_no, doc_id, source, text, case when doc_id is null then '-' else octet_length(encode(doc_id::varchar)) || ':' || doc_id end || case when source is null then '-' else octet_length(encode(source)) || ':' || source end
                || case when lang is null then '-' else octet_length(encode(lang)) || ':' || lang end || case when n_chars is null then '-' else octet_length(encode(n_chars::varchar)) || ':' || n_chars end head from documents),
        e as (select row_no, doc_id, source, sha256(head || case when text is null then '-' else octet_length(encode(text)) || ':' || text end) leaf,
            sha256(head || case when text is null then '-' else octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '') end) cut, text from d),
        k as (select source, dense_rank() over (order by source nulls first) - 1 tree, row_number() over (partition by source order by row_no) - 1 pos, row_no, doc_id, leaf, cut from e),
        own(tree, lvl, pos, h, n) as (select tree, 0, pos, leaf, count(*) over (partition by tree) from k
            union all select tree, lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)), any_value((n + 2) // 3) from own where n > 1 group by tree, lvl, pos // 3),
        sub as (select tree, h from own where n = 1),
        top(lvl, pos, h, n) as (select 0, tree, h, count(*) over () from sub
            union all select lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)), any_value((n + 2) // 3) from top where n > 1 group by lvl, pos // 3),
        root as (select h from top where n = 1),
        odd(b) as (select 0 union all select b + 1 from odd where b < 255),
        crc(b, r, c) as (select b, 0, b::bigint from odd union all select b, r + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where r < 8),
        tab as materialized (select b, c from crc where r = 8),
        sums(row_no, i, c) as (select row_no, 1, 4294967295::bigint from k where doc_id is not null
            union all select s.row_no, i + 1, xor(s.c >> 8, t.c) from sums s join k on k.row_no = s.row_no join tab t on t.b = xor(s.c, ascii(substr(k.doc_id::varchar, i, 1))) & 255 where i <= length(k.doc_id::varchar)),
        summed as (select row_no, arg_max(c, i) c from sums group by row_no),
        s as (select k.*, case when xor(c, 4294967295) % 2 = 0 then cut else leaf end given from k left join summed on summed.row_no = k.row_no),
        runs as (select tree, lvl, pos // 3 run, list(h order by pos) hs from own where n > 1 group by all union all select -1, lvl, pos // 3, list(h order by pos) from top where n > 1 group by all),
        climb(row_no, tree, src, lvl, pos, h, proof) as (select row_no, tree, tree, 0, pos, given, '' from s
            union all select c.row_no, case when r.run is null then -1 else c.tree end, src, case when r.run is null then 0 else c.lvl + 1 end, case when r.run is null then src else c.pos // 3 end,
                case when r.run is null then c.h else sha256(array_to_string(r.hs[1:c.pos % 3], '') || c.h || array_to_string(r.hs[c.pos % 3 + 2:], '')) end,
                case when r.run is null then c.proof else c.proof || array_to_string(r.hs[1:c.pos % 3], '') || array_to_string(r.hs[c.pos % 3 + 2:], '') end
            from climb c left join runs r on r.tree = c.tree and r.lvl = c.lvl and r.run = c.pos // 3 where r.run is not null or c.tree >= 0),
        done as (select row_no, arg_max(h, (tree = -1, lvl)) h, arg_max(proof, (tree = -1, lvl)) proof from climb where tree = -1 group by row_no)
        select s.doc_id, s.leaf, sub.h subroot, root.h root, sha256(done.proof) proof_sha256, done.h folded_root, done.h = root.h verified from s join sub on sub.tree = s.tree join done on done.row_no = s.row_no cross join root""",
}
