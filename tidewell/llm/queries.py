"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .embedding_dedup import near_duplicates
from .html_text import extract
from .jaccard import jaccard_components
from .licenses import scan
from .lm_score import lm_scores
from .packing import pack
from .quality import quality
from .sharding import shard
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source/lang/doc_id."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    out = scan(docs.select(F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text"))
    return out.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "path", "license", "score", "origin", "licensed_by")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["length"])), ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.array_join("near_items", ",").alias("near_items"), spans.alias("spans"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"), [1.0] * 16)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), 4, (85, 100))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_licenses, op3_decontamination, op4_sharding, op5_toxicity, op6_html, op7_embedding_dedup, op8_lm_scores, op9_jaccard, op10_quality)}


#: A-Z to a-z only, as the word rules ask for.
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_packing": r"""WITH RECURSIVE t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
h AS (SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS x, count(*) AS c FROM t GROUP BY n_tokens),
s AS (SELECT j, x, sum(c) OVER w AS c, sum(x * c) OVER w AS s FROM h WINDOW w AS (ORDER BY j)), p AS (SELECT 0 AS j, 0::BIGINT AS x, 0::HUGEINT AS c, 0::HUGEINT AS s UNION ALL SELECT * FROM s), n AS (SELECT max(j) AS n, least(16, max(j)) AS k FROM p),
dp AS (SELECT 1 AS k, j, x * c - s AS cost, 0::BIGINT AS pick FROM p UNION ALL
SELECT k, j, best.cost, best.pick FROM (SELECT d.k + 1 AS k, b.j, min({'cost': d.cost + b.x * (b.c - a.c) - (b.s - a.s), 'pick': a.j}) AS best FROM dp d JOIN p a ON a.j = d.j JOIN p b ON b.j > a.j, n WHERE d.k < n.k GROUP BY 1, 2 UNION ALL SELECT d.k + 1, 0, {'cost': 0::HUGEINT, 'pick': 0::BIGINT} FROM dp d, n WHERE d.k < n.k AND d.j = 0)),
b AS (SELECT n.k, n.n AS j FROM n WHERE n.n > 0 UNION ALL SELECT b.k - 1, dp.pick FROM b JOIN dp ON dp.k = b.k AND dp.j = b.j WHERE dp.pick > 0),
u AS (SELECT row_number() OVER (ORDER BY x) - 1 AS bucket, x AS bucket_len, coalesce(lag(x) OVER (ORDER BY x), -1) AS low FROM b JOIN p USING (j)),
r AS (SELECT doc_id, n_tokens, bucket, bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY coalesce(('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 256, 0), doc_id NULLS FIRST, n_tokens) - 1 AS i, greatest(1, 16384 // greatest(1, bucket_len)) AS room FROM t JOIN u ON n_tokens > low AND n_tokens <= bucket_len)
SELECT doc_id, n_tokens, bucket::INT AS bucket, bucket_len, (i // room)::BIGINT AS batch, (i % room)::INT AS place, bucket_len - n_tokens AS padding FROM r""",
    # crc32 bit by bit: each byte is followed by eight shifts, which are marked by -1
    "op4_sharding": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
e AS (SELECT doc_id, t, list_transform(range(17), lambda s: -1.0::DOUBLE / ln((('0x' || md5(k || ':' || s)[1:15])::BIGINT::DOUBLE + 0.5::DOUBLE) / 1152921504606846976::DOUBLE)) AS bid, coalesce(('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 1024, 0) AS salt FROM d),
c AS (SELECT doc_id, salt, octet_length(t) + 1 AS size, (list_position(bid[1:16], list_max(bid[1:16])) - 1)::INT AS shard, (list_position(bid, list_max(bid)) - 1)::INT AS grown_shard,
xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(t), '..'), lambda x: [('0x' || x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS text_crc32 FROM e)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY salt, doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard FROM c""",
    "op3_decontamination": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, k, dw.n, item FROM dw JOIN iw USING (n, s)), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY 1),
sp AS (SELECT r, string_agg((k - 1) || ':' || n, ',' ORDER BY k, n) AS spans FROM (SELECT DISTINCT r, k, n FROM m) GROUP BY 1),
iww AS (SELECT rowid AS g, item, unnest(w) AS word FROM (SELECT row_number() OVER () AS rowid, item, w FROM i) WHERE len(w) >= 10), often AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM i) GROUP BY 1),
rare AS (SELECT g, item, word, k, max(k) OVER (PARTITION BY g) AS many FROM (SELECT g, item, word, row_number() OVER (PARTITION BY g ORDER BY c, -strlen(word), word) AS k FROM (SELECT DISTINCT g, item, word FROM iww) JOIN often USING (word)) WHERE k <= 4),
pos AS (SELECT r, word, p FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d) WHERE word IN (SELECT word FROM rare)),
near AS (SELECT DISTINCT r, item FROM (SELECT a.r, x.g, x.item, a.p FROM rare x JOIN pos a ON a.word = x.word AND x.k = 1 AND x.many = 4 JOIN rare y ON y.g = x.g AND y.k > 1 JOIN pos b ON b.r = a.r AND b.word = y.word AND abs(b.p - a.p) <= 40 GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT y.k) = 3)),
ni AS (SELECT r, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT r, item FROM near EXCEPT SELECT r, item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, '') AS near_items, coalesce(spans, '') AS spans
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN sp USING (r) LEFT JOIN ni USING (r)""",
    "op7_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a), c AS (SELECT node, min(seen) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id""",
    "op9_jaccard": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a), c AS (SELECT node, min(seen) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM d JOIN c ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
