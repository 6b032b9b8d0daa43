"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrail.llm import bpe, clustering, conversation_repair, decontamination, jpeg, language_id, lm_score, mixing, near_dup, syncmers, toxicity, url_filter, warc
from contrail.llm.common import bounded_batches, held_out, table, with_small_batches

#: Host and path rules of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out("doc_id")), language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return language_id.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through monolithic archives, the normaliser and back by the offset index."""
    archives, _ = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under counts of the word bigrams of all other documents."""
    x = lm_score.score_left_out(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 3))
    return x.select("doc_id", "n_words", "n_backed_off", "log_score", F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_log_score"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    vocab = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    model = url_filter.fit(url_filter.labelled_table(spark).where("not held_out"))
    return url_filter.judge(table(spark, sf_dir, "pages"), model, URL_RULES)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a JPEG file, read back and described."""
    media = jpeg.store_column(table(spark, sf_dir, "documents")).select(F.struct("doc_id", "n_bytes").alias("key"), "media")
    x = jpeg.features(media, id_col="key")
    feature = F.format_string("%dx%d:%s:%s", "width", "height", "average_hash", "difference_hash")
    return x.select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprints of every document and of its edited text, and their likeness."""
    x = syncmers.with_next(table(spark, sf_dir, "documents"), syncmers.fingerprint)
    kept, new = syncmers.edited_parts(F.col("text"), F.col("next_text"))
    x = x.withColumn("edited_fp", syncmers.joined(F.col("fp"), F.col("next_fp"), kept, new))
    fp, efp, nfp = (F.array_distinct(F.col(c)["hashes"]) for c in ("fp", "edited_fp", "next_fp"))
    x = x.withColumn("fingerprint", syncmers.encoded(F.col("fp"))).withColumn("edited_fingerprint", syncmers.encoded(F.col("edited_fp")))
    return x.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.concat(kept, new), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        syncmers.likeness(fp, efp).alias("near_edited"),
        syncmers.likeness(fp, nfp).alias("near_next"),
        syncmers.in_place(F.col("fp"), F.col("edited_fp")).alias("in_place_edited"),
        F.sha2("fingerprint", 256).alias("fingerprint_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix of the sources by weights 5, 2, 1 with at most three epochs."""
    x = mixing.mix(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds."""
    members, centroids, _ = clustering.kmeans(table(spark, sf_dir, "embeddings"))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame(list(enumerate(shas)), "cluster int, centroid_sha256 string")
    each = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = each.join(F.broadcast(named), "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return members.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are in occurrences of ten-word windows of benchmark items, and those items."""
    bounded_batches(spark)
    x = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return x.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by a hash of their ids and turns: a row dropped (``gone``), without text, without sentence
    ends, twice, or said by the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return x.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), times.alias("time"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    bounded_batches(spark)
    return conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


QUERIES = {f.__name__: with_small_batches(f) for f in (op1_language_id, op2_warc, op3_lm_score, op4_near_dup, op5_bpe, op6_url_filter, op7_media, op8_fingerprint, op9_toxicity, op10_mixing, op11_clustering, op12_decontamination, op13_conversation_repair)}

ORACLES = {
    "op3_lm_score": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT r, unnest(list_prepend('', w[:-2])) AS v, unnest(w) AS w FROM t WHERE len(w) > 0),
        own_k AS (SELECT r, v, w, count(*) AS n FROM b GROUP BY r, v, w),
        own_c AS (SELECT r, v, sum(n) AS n FROM own_k GROUP BY r, v),
        own_u AS (SELECT r, w, sum(n) AS n FROM own_k GROUP BY r, w),
        k AS (SELECT v, w, sum(n) AS n FROM own_k GROUP BY v, w),
        c AS (SELECT v, sum(n) AS n FROM k GROUP BY v),
        u AS (SELECT w, sum(n) AS n FROM k GROUP BY w),
        g AS (SELECT r, o.n, k.n - o.n AS kn, c.n - oc.n AS cn, greatest(u.n - ou.n, 1) AS un, greatest((SELECT sum(n) FROM k) - len(t.w), 1) AS total
              FROM own_k o JOIN own_c oc USING (r, v) JOIN own_u ou USING (r, w) JOIN k USING (v, w) JOIN c USING (v) JOIN u USING (w) JOIN t USING (r)),
        s AS (SELECT r, sum(CASE WHEN kn = 0 THEN n ELSE 0 END) AS backed,
                     sum(n * CASE WHEN kn > 0 THEN ln(kn) - ln(cn) ELSE ln(0.4) + ln(un) - ln(total) END) AS s FROM g GROUP BY r),
        o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(s.backed, 0) AS BIGINT) AS n_backed_off, round(round(coalesce(s.s, 0), 6), 3) AS log_score
              FROM t LEFT JOIN s ON s.r = t.r)
        SELECT doc_id, n_words, n_backed_off, log_score, CASE WHEN n_words > 0 THEN round(log_score / n_words, 6) END AS mean_log_score FROM o""",
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        a AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN a.top IS NULL OR a.top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN a.top <> page_id THEN a.top END AS refers_to
        FROM p LEFT JOIN a ON p.d = a.d AND p.n >= 1000""",
    "op10_mixing": """
        WITH r AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                          ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS o FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM r GROUP BY source),
        f AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
        g AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS fill, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM f),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
              FROM g WINDOW b AS (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT level FROM l WHERE level <= fill ORDER BY fill, rank LIMIT 1),
        t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM v)), cap) AS target FROM l),
        x AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
                     coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               CAST((whole + CASE WHEN whole < 3 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x""",
}


def _clustering_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """k-means as a chain of common tables: centroids, members, centroids, ..."""
    parts = [
        f"""v0 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
               WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x FROM v0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT r, c, CAST(list_sum(list_transform(generate_series(1, {dims}), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i]))) AS BIGINT) AS d FROM v, c{i} AS k) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT d.m.c AS c, i, sum(v.x[i]) AS s, count(*) AS n FROM d{i} AS d JOIN v USING (r), generate_series(1, {dims}) AS g(i) GROUP BY ALL)""")
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.x, k.x) AS x FROM c{i} AS k LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{i} GROUP BY c) AS n ON n.c = k.c)""")
    return f"""WITH {', '.join(parts)}
        SELECT vec_id, CAST(d.m.c AS INTEGER) AS cluster, d.m.d AS distance, CAST(sum(d.m.d) OVER (PARTITION BY d.m.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
        FROM d{rounds} AS d JOIN v USING (r) JOIN c{rounds} AS k ON k.c = d.m.c"""


ORACLES["op11_clustering"] = _clustering_sql()

ORACLES["op12_decontamination"] = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
          FROM b, generate_series(1, greatest(len(w) - 9, 1)) AS g(i) WHERE len(w) > 0),
    x AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM p), generate_series(1, len(w) - n + 1) AS g(i)),
    m AS (SELECT r, x.n, i, item_id FROM x JOIN p ON p.s = x.s AND p.n = x.n),
    h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, n, i FROM m), generate_series(i, i + n - 1) AS g(j) GROUP BY r),
    t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""

ORACLES["op13_conversation_repair"] = r"""
    WITH RECURSIVE
    tab AS (SELECT list(list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
    o AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
    c AS (SELECT o.k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
          FROM conversations AS c JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id),
    f AS (SELECT k, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a // 256, tab.t[xor(a % 256, b) + 1])), 4294967295) % 20 AS f FROM c, tab),
    d AS (SELECT k, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM f, range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
    g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM d),
    n AS MATERIALIZED (SELECT k, i, turn, role, text, role[1:1] AS a, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd' WHEN body[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                 lag(role[1:1]) OVER (PARTITION BY k ORDER BY i) || role[1:1] AS two FROM g),
    st AS (SELECT k, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM n GROUP BY k),
    dp AS (SELECT k, 0 AS i, s, cost, audit FROM st, (VALUES (0, 0, ''), (2, 5, 'I'), (3, 10, 'II')) AS v(s, cost, audit)
           UNION ALL
           SELECT k, i, s, m.cost AS cost, m.audit AS audit FROM (
               SELECT k, i, s, min({'cost': cost, 'audit': audit}) AS m FROM (
                   SELECT k, i, CASE ins WHEN 0 THEN s WHEN 1 THEN CASE s WHEN 2 THEN 3 ELSE 2 END ELSE CASE s WHEN 2 THEN 2 ELSE 3 END END AS s, cost + 5 * ins AS cost, audit || repeat('I', ins) AS audit
                   FROM (SELECT dp.k, dp.i + 1 AS i, CASE op WHEN 'D' THEN dp.s WHEN 'R' THEN CASE dp.s WHEN 2 THEN 3 ELSE 2 END ELSE CASE n.a WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS s,
                                dp.cost + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND n.fault = 't' THEN 5 ELSE 0 END AS cost, dp.audit || op AS audit
                         FROM dp JOIN n ON n.k = dp.k AND n.i = dp.i + 1, (VALUES ('K'), ('R'), ('D')) AS e(op)
                         WHERE op = 'D' OR (n.fault NOT IN ('b', 'd') AND (op = 'R' OR CASE dp.s WHEN 0 THEN n.a IN ('s', 'u') WHEN 2 THEN n.a = 'a' ELSE n.a = 'u' END))), range(3) AS r(ins))
               GROUP BY k, i, s)),
    best AS (SELECT dp.k, min({'cost': cost, 'audit': audit}) AS m FROM dp JOIN st ON st.k = dp.k AND st.rows = dp.i WHERE s IN (0, 3) GROUP BY dp.k),
    u AS (SELECT k, p, m.audit[p:p] AS e, length(replace(m.audit[1:p], 'I', '')) AS i, length(replace(m.audit[1:p], 'D', '')) AS pos FROM best, range(1, length(m.audit) + 1) AS r(p)),
    w AS (SELECT u.k, u.p, u.e, u.pos, n.role, n.text, bool_or(u.e = 'K' AND n.a = 's') OVER (PARTITION BY u.k) AS sys FROM u LEFT JOIN n ON n.k = u.k AND n.i = u.i AND u.e <> 'I' WHERE u.e <> 'D'),
    y AS (SELECT k, string_agg(CASE WHEN e = 'K' THEN role WHEN (pos - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM w GROUP BY k)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(best.m.cost, 0) AS BIGINT) AS cost, coalesce(best.m.audit, '') AS audit, sha256(coalesce(y.t, '')) AS repaired_sha256
    FROM o LEFT JOIN st USING (k) LEFT JOIN best USING (k) LEFT JOIN y USING (k)"""
