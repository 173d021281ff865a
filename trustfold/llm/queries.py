"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, embed_dedup, exact_dedup, hpylm, langid, line_dedup, mixing, periodic_runs, simhash, suffix_dedup, url_filter
from .common import LOWER, UPPER

#: The explicit rules of the URL query: (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(folds: int):
    """crc32(doc_id as text) mod folds; a row without an id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang").where(crc_fold(3) != 1))
    rows = docs.select("doc_id", (crc_fold(3) == 1).alias("held_out"), "text")
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are mined from ``labels`` of the document that a page holds, whose id is the last number of the url's path: a toxic document marks a bad page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    held = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') AS bigint)")
    holds = pages.select("page_id", url_filter.url_path(F.col("url")).alias("path")).select("page_id", held.alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("bad"))
    return url_filter.filter_urls(pages, holds.join(labels, "doc_id").select("page_id", "bad"), URL_RULES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines without those that repeat an earlier line within two edits."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    return chat_format.chat_digests(chat_format.chat_windows(rows.unionByName(extra)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) with the item in the document within a tenth of its length in edits."""
    return decontaminate.best_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), "n_tokens", F.round("mix_weight", 6).alias("weight"), F.round("mix_prob", 6).alias("prob"), F.col("mix_keep").alias("kept")
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.98)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold(5) == 1).alias("held_out"))
    return hpylm.score(docs)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract plants a run in every tenth document, by its id: from a word on, the words repeat with a period. Then the operator judges the words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("doc_id").cast("string")).alias("h"), "text")
    words = r"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END"
    cut = docs.withColumn("ws", F.expr(words)).withColumn("n", F.size("ws"))
    cut = cut.withColumn("a", F.expr("CASE WHEN n > 0 THEN int(h div 10 % n) END")).withColumn("p", F.expr("int(1 + (n - a) div (3 + h div 10 % 8))"))
    repeated = F.expr("slice(concat(slice(ws, 1, a), flatten(array_repeat(slice(ws, a + 1, p), int((n - a) div p + 1)))), 1, n)")
    found = periodic_runs.find_runs(cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text")))
    best = F.expr("aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> CASE WHEN b IS NULL OR r.length > b.length THEN r ELSE b END)")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_simhash": op2_simhash,
        "op3_url_filter": op3_url_filter,
        "op4_line_dedup": op4_line_dedup,
        "op5_chat_format": op5_chat_format,
        "op6_decontamination": op6_decontamination,
        "op7_mixing": op7_mixing,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_source_divergence": op13_source_divergence,
    }


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role,'') role, coalesce(text,'') text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *,
  replace(replace(replace(replace(replace(role,'&','&amp;'),'<','&lt;'),'>','&gt;'),'[','&lb;'),']','&rb;') er,
  replace(replace(replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;'),'[','&lb;'),']','&rb;') et FROM turns),
m AS (SELECT *, length('<|'||er||'|>'||et||'</s>') chars,
  (ceil(length('<|'||er||'|>'||et||'</s>')/4.0)+1)::BIGINT tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) pos FROM esc),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos)::BIGINT upto,
  min(CASE WHEN role='system' THEN pos END) OVER (PARTITION BY conv_id) sys_pos,
  first(CASE WHEN role='system' THEN tokens END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY CASE WHEN role='system' THEN pos END NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) sys_tokens,
  first(CASE WHEN role='system' THEN chars END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY CASE WHEN role='system' THEN pos END NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) sys_chars FROM m),
p AS (SELECT *, upto-tokens AS st, greatest(1, 832-coalesce(sys_tokens,0))::BIGINT room FROM s),
q AS (SELECT *, st//room slot, (st//room) <> ((upto-1)//room) alone FROM p),
h AS (SELECT *, coalesce(sum(CASE WHEN sys_pos IS NULL OR pos<>sys_pos THEN chars ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY st RANGE BETWEEN 192 PRECEDING AND 1 PRECEDING),0) past FROM q),
w AS (SELECT conv_id, slot, alone, sum(chars)::BIGINT own, min(pos) fp, min_by(past,pos)::BIGINT past, first(sys_pos) sys_pos, first(sys_chars) sys_chars FROM h GROUP BY 1,2,3),
c AS (SELECT conv_id, sum(own+past+CASE WHEN sys_pos < fp THEN sys_chars ELSE 0 END)::BIGINT formatted_chars, count(*) n_windows FROM w GROUP BY 1)
SELECT m.conv_id, count(*) n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY pos)) turns_sha256,
  length(coalesce(string_agg(CASE WHEN role='assistant' THEN text END, '' ORDER BY pos),''))::BIGINT loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role='assistant' THEN text END, '' ORDER BY pos),'')) loss_sha256,
  any_value(formatted_chars) formatted_chars, any_value(n_windows) n_windows
FROM m JOIN c ON m.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY m.conv_id
"""


def op7_sql(docs: str = "documents", select: str = "", rounds: int = 12, passes: int = 6, keep_share: float = 0.5, alpha: float = 0.5, seed: int = 17) -> str:
    """Raking and calibration unrolled; the same arithmetic as the operator, over the same cells."""
    dims = ("source", "lang", "topic")
    sql = rf"""WITH d AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')),0)::BIGINT n_tokens,
  CASE WHEN coalesce(length(text),0)=0 THEN 'empty' WHEN contains(text,' | ') THEN 'table' WHEN contains(text,'### ') THEN 'markup'
   WHEN length(text)<1000 THEN 'short' WHEN length(text)<4000 THEN 'medium' ELSE 'long' END topic FROM {docs}),
c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT tokens FROM d GROUP BY 1,2,3),
a AS (SELECT sum(tokens)::DOUBLE total FROM c)"""
    for x in dims:
        sql += f",\ng_{x} AS (SELECT {x}, pow(t,{alpha})/sum(pow(t,{alpha})) OVER () target FROM (SELECT {x}, sum(tokens)::DOUBLE t FROM c GROUP BY 1) WHERE t>0)"
    sql += ",\nr0 AS (SELECT c.*, tokens/total w FROM c, a)"
    n = 0
    for _ in range(rounds):
        for x in dims:
            sql += (
                f",\nf{n} AS (SELECT s.{x}, CASE WHEN now>0 THEN coalesce(target,0)/now ELSE 0 END f FROM (SELECT {x}, sum(w) now FROM r{n} GROUP BY 1) s LEFT JOIN g_{x} g ON s.{x} IS NOT DISTINCT FROM g.{x})"
                f",\nr{n + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.tokens, r.w*f.f w FROM r{n} r LEFT JOIN f{n} f ON r.{x} IS NOT DISTINCT FROM f.{x})"
            )
            n += 1
    sql += f",\np0 AS MATERIALIZED (SELECT *, least(1.0, CASE WHEN tokens>0 THEN w/(tokens/(SELECT total FROM a)) ELSE 0 END*{keep_share}::DOUBLE)::DOUBLE p FROM r{n})"
    for i in range(passes):
        sql += (
            f",\nu{i} AS (SELECT CASE WHEN pt>0 THEN greatest(1.0, ({keep_share}*(SELECT total FROM a)-ft)/pt) ELSE 1.0 END up FROM (SELECT sum(CASE WHEN p>=1 THEN tokens ELSE 0 END) ft, sum(CASE WHEN p>=1 THEN 0 ELSE tokens*p END) pt FROM p{i}))"
            f",\np{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (p), CASE WHEN p>=1 THEN 1.0 ELSE least(1.0, p*(SELECT up FROM u{i})) END::DOUBLE p FROM p{i})"
        )
    sql += (
        f",\no AS (SELECT d.*, q.w, CASE WHEN d.n_tokens=0 THEN 1.0 ELSE q.p END::DOUBLE p, (('0x'||substr(md5('{seed}:'||coalesce(d.doc_id::VARCHAR,'null')),1,13))::BIGINT)::DOUBLE/4503599627370496.0 draw"
        f" FROM d LEFT JOIN p{passes} q ON d.source IS NOT DISTINCT FROM q.source AND d.lang IS NOT DISTINCT FROM q.lang AND d.topic IS NOT DISTINCT FROM q.topic)\n"
    )
    return sql + (select or "SELECT doc_id, source, lang, topic, n_tokens, round(w,6) weight, round(p,6) prob, draw < round(p,9) kept FROM o")


OP8_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(v, v)) AS size FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0 WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS reach FROM e UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON id = vec_id
"""

OP12_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
langs AS (SELECT d.lang, count(k.term) AS v, coalesce(sum(k.c), 0) AS n FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN kept k ON d.lang = k.lang GROUP BY ALL),
here AS (SELECT w.lang, source, term, count(*) AS c FROM w JOIN kept k USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(h.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN here h ON g.lang = h.lang AND g.source = h.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(h.c, 0) + 5) // (g.n + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.c + 5) // (l.n + 5 * l.v) AS q
    FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON g.lang = k.lang LEFT JOIN here h ON g.lang = h.lang AND g.source = h.source AND k.term = h.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
    (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": OP5_SQL, "op7_mixing": op7_sql(), "op8_embedding_dedup": OP8_SQL, "op12_exact_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
