"""The registered queries of the operators, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
l AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM l)),
ns AS (SELECT DISTINCT n FROM l),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


@query("op1_decontaminate", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.decontaminate import contamination
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


_OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, s, array_to_string(w[s:s+12], ' ') AS k FROM g),
m AS (SELECT k, min(doc_id) AS first_doc FROM k GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM k JOIN m USING (k) WHERE first_doc < doc_id),
rl AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(coalesce(ps, []), i)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN rl ON d.doc_id = rl.doc_id
"""


@query("op6_substring_dedup", _OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.substring_dedup import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on every machine (a parameter of the operators)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.bpe import encode_decode
    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op5_token_orc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.token_orc import digest, store_and_read
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(store_and_read(docs, vocabulary("word_bpe_49k.json")))


_OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, u.y FROM r JOIN u ON r.reach = u.x),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op4_near_dedup", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.near_dedup import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_langid")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.langid import fit, held_out, identify
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5)).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_lattice_lm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.lattice_lm import score
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


_OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
      AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, u.y FROM r JOIN u ON r.reach = u.x),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT x, count(*) AS n FROM u GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""


@query("op10_vector_dedup", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.vector_dedup import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op2_html_extract")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.html_extract import extract
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS s FROM d WHERE length(h) >= 400)),
m AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
w AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM k SEMI JOIN m USING (k)),
g AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM w),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, run),
l AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb FROM r GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN aa IS NULL THEN h ELSE array_to_string([substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE bb[i - 1] END) + 1,
         2 * ((CASE WHEN i > len(aa) THEN length(h) // 2 ELSE aa[i] END) - (CASE WHEN i = 1 THEN 0 ELSE bb[i - 1] END))) FOR i IN range(1, len(aa) + 2)], '') END)) AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id
"""


@query("op7_suffix_dedup", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.suffix_dedup import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_token_align")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.token_align import cross_align
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cross_align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_OP12_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT page_id, h, n, max(page_id) OVER (PARTITION BY h, n) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
                        FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""


@query("op12_warc", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.warc import store_and_read
    out = store_and_read(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.periodic_runs import periodic_runs
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True, outputs=False)
