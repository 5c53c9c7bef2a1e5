"""Registered queries of the corpus operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cholesky_whitening,
    crf_lines,
    extendible,
    golay_simhash,
    merkle_rank,
    mix_tree,
    radix_dedup,
    secret_owners,
    swap_packing,
    tool_calls,
    toxic_neighbours,
    warc_store,
    weak_pii,
)
from .common import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(function):
    Q[function.__name__] = function
    return function


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    limits = crf_lines.Limits()
    model = crf_lines.fit(crf_lines.training_segments(docs, labels, limits), limits)
    return docs.select("doc_id", crf_lines.judged(model).alias("j")).select("doc_id", "j.*")


@query
def op2_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxic_neighbours.fit(docs, toxic_neighbours.learnable(labels))
    return docs.select("doc_id", toxic_neighbours.held_out().alias("held_out"), *toxic_neighbours.toxicity(docs, model))


# The rules of three tools; ``style`` is a field that no derived call has.
RULES = [
    ("search", "query", "string", True, None, None),
    ("search", "limit", "integer", True, 1.0, 20.0),
    ("search", "after", "string", False, None, None),
    ("fetch", "query", "string", True, None, None),
    ("fetch", "limit", "integer", False, None, None),
    ("fetch", "after", "string", False, None, None),
    ("summarise", "query", "string", True, None, None),
    ("summarise", "limit", "string", False, None, None),
    ("summarise", "style", "string", True, None, None),
]


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as calls (the turn two before is a dependency), the turns after them as results."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    arguments = F.concat(
        F.lit('{ "query": '), tool_calls.quoted(F.coalesce(F.col("text"), F.lit(""))),
        F.lit(', "limit": '), (F.length("text") % 25).cast("string"),
        F.when(F.col("turn") >= 2, F.concat(F.lit(', "after" : "$ref:'), name(F.col("turn") - 2), F.lit('"'))).otherwise(F.lit("")),
        F.lit(" }"),
    )
    tool = F.element_at(F.array(*map(F.lit, ("search", "fetch", "summarise"))), (F.col("turn") % 3 + 1).cast("int"))
    said = turns.filter(F.col("role") == "assistant")
    calls = said.select("conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), tool.alias("name"), arguments.alias("arguments"))
    results = turns.filter(F.col("role") != "assistant").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    names = ("tool", "field", "type", "required", "low", "high")
    kinds = dict(zip(names, ("string", "string", "string", "boolean", "double", "double"), strict=True))
    listed = [F.struct(*[F.lit(value).cast(kinds[n]).alias(n) for n, value in zip(names, rule, strict=True)]) for rule in RULES]
    rules = spark.range(1).select(F.inline(F.array(*listed)))
    return tool_calls.link_calls(calls, results, rules)


SQL["op3_tool_calls"] = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn AS seq, 'call_' || conv_id || '_' || turn AS call_id,
    CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'fetch' ELSE 'summarise' END AS name,
    length(text) % 25 AS lim, coalesce(text, '') AS q
  FROM conversations WHERE role = 'assistant'),
levels AS (
  SELECT c.conv_id, c.seq, 0::BIGINT AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.seq = c.seq - 2)
  UNION ALL
  SELECT c.conv_id, c.seq, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.seq = l.seq + 2),
answers AS (SELECT conv_id, turn - 1 AS seq, min(text) AS result, count(*) AS n FROM conversations WHERE role <> 'assistant' GROUP BY ALL),
met AS (
  SELECT c.*, l.level, a.result, coalesce(a.n, 0) AS n_results,
    CASE WHEN a.n > 0 THEN 'linked' ELSE 'unanswered' END AS status,
    CASE WHEN c.seq >= 2 AND l.level = 0 THEN 1 ELSE 0 END::BIGINT AS n_missing,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY l.level, c.seq) AS position
  FROM calls c JOIN levels l USING (conv_id, seq) LEFT JOIN answers a USING (conv_id, seq))
SELECT conv_id, call_id, seq, name, status, n_results, n_missing, level, position,
  CASE name WHEN 'search' THEN CASE WHEN lim < 1 OR lim > 20 THEN 'limit:range' ELSE '' END
    WHEN 'fetch' THEN '' ELSE CASE WHEN seq >= 2 THEN 'after:unknown,' ELSE '' END || 'limit:type,style:missing' END AS violations,
  '{"arguments":{' || CASE WHEN seq >= 2 THEN '"after":"$ref:call_' || conv_id || '_' || (seq - 2) || '",' ELSE '' END
    || '"limit":' || lim || ',"query":' || to_json(q)::VARCHAR || '},"id":"' || call_id || '","name":"' || name || '","position":' || position
    || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS message
FROM met
UNION ALL
SELECT conv_id, 'call_' || conv_id || '_' || seq, NULL, NULL, 'orphan', n, 0, NULL, NULL, '',
  '{"arguments":null,"id":"call_' || conv_id || '_' || seq || '","name":null,"position":null,"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}'
FROM answers a WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = a.conv_id AND c.seq = a.seq)
"""


@query
def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", golay_simhash.hex_print("print").alias("fingerprint"), "component_id")


@query
def op5_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc_store.archive_pages(table(spark, sf_dir, "pages"))
    return warc_store.parsed(archive.read())


SQL["op5_warc_store"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= {warc_store.LEAST} THEN max(page_id) OVER (PARTITION BY html) END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best > page_id THEN best END AS refers_to
FROM m
"""


@query
def op6_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_owners.find_secrets(table(spark, sf_dir, "documents"))


@query
def op7_extendible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.extendible_shards(table(spark, sf_dir, "documents"))


SQL["op7_extendible"] = f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::UBIGINT::BIGINT AS h FROM documents),
e AS (SELECT r.*, d.depth, h >> ({extendible.BITS} - d.depth) AS prefix FROM r, (SELECT unnest(range(0, 61))::INTEGER AS depth) d),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows, min(h) = max(h) AS single FROM e GROUP BY ALL),
f AS (SELECT e.doc_id, e.n_bytes, e.depth, e.prefix, s.shard_bytes, s.shard_rows,
    row_number() OVER (PARTITION BY e.doc_id ORDER BY e.depth) AS k
  FROM e JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {extendible.LIMIT} OR s.single)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_rows,
  shard_bytes > {extendible.LIMIT} AS over_limit
FROM f WHERE k = 1
"""


@query
def op8_mix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; shards and positions are those of all copies."""
    plan = mix_tree.placed_documents(mix_tree.mix_plan(table(spark, sf_dir, "documents")))
    first = F.get("shards", F.lit(0)).alias("first_shard")
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", first, "shards", "positions")


@query
def op9_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_classes(table(spark, sf_dir, "documents"))


SQL["op9_radix_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query
def op10_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op11_merkle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    leaf = merkle_rank.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text"))
    return merkle_rank.manifest(docs, changed=merkle_rank.altered(F.col("doc_id"), F.col("n_chars"), leaf))


SQL["op11_merkle_rank"] = """
WITH RECURSIVE
f AS (SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS b,
    coalesce(strlen(lang) || ':' || lang, '-') AS c, coalesce(strlen(text) || ':' || text, '-') AS e FROM documents),
crc AS (
  SELECT doc_id, 0 AS k, 4294967295::BIGINT AS r FROM documents
  UNION ALL
  SELECT doc_id, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM (SELECT doc_id, k, CASE WHEN k % 8 = 0 THEN xor(r, ascii(substr(CAST(doc_id AS VARCHAR), k // 8 + 1, 1))::BIGINT) ELSE r END AS v
    FROM crc WHERE k < 8 * strlen(CAST(doc_id AS VARCHAR)))),
hit AS (SELECT doc_id FROM crc WHERE k = 8 * strlen(CAST(doc_id AS VARCHAR)) AND xor(r, 4294967295) % 7 = 0),
leaves AS (SELECT f.doc_id, lang, sha256(a || b || c || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || e) AS leaf,
    sha256(a || b || c || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-') || e) AS used
  FROM (SELECT f.*, n_chars + CASE WHEN hit.doc_id IS NULL THEN 0 ELSE 1 END AS m FROM f LEFT JOIN hit USING (doc_id)) f),
lv AS (
  SELECT lang, 0 AS level, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subs AS (SELECT lang, h AS subroot, level AS top FROM lv WHERE n = 1),
tl AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, subroot AS h FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tl WHERE n > 1 GROUP BY level, pos // 2, n),
tops AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tpos FROM subs),
nodes AS (
  SELECT coalesce('=' || lang, '') AS g, level, pos, h FROM lv WHERE n > 1
  UNION ALL SELECT '#', level, pos, h FROM tl WHERE n > 1),
height AS (SELECT coalesce('=' || lang, '') AS g, max(level) AS top FROM lv GROUP BY 1 UNION ALL SELECT '#', max(level) FROM tl),
walk AS (
  SELECT doc_id, coalesce('=' || l.lang, '') AS g, 0 AS level, row_number() OVER (PARTITION BY l.lang ORDER BY doc_id) - 1 AS pos, tpos, '' AS proof, used AS h
  FROM leaves l JOIN tops ON l.lang IS NOT DISTINCT FROM tops.lang
  UNION ALL
  SELECT doc_id, CASE WHEN up THEN '#' ELSE w.g END, CASE WHEN up THEN 0 ELSE w.level + 1 END, CASE WHEN up THEN tpos ELSE w.pos // 2 END, tpos,
    CASE WHEN up THEN proof ELSE proof || coalesce(o.h, '') END,
    CASE WHEN up THEN w.h WHEN o.h IS NULL THEN sha256(w.h) WHEN w.pos % 2 = 1 THEN sha256(o.h || w.h) ELSE sha256(w.h || o.h) END
  FROM (SELECT walk.*, walk.level = height.top AS up FROM walk JOIN height USING (g) WHERE NOT (g = '#' AND walk.level = height.top)) w
  LEFT JOIN nodes o ON o.g = w.g AND o.level = w.level AND o.pos = xor(w.pos, 1))
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified,
  (strlen(w.proof) // 64)::INTEGER AS depth
FROM walk w JOIN height x ON x.g = '#' AND w.g = '#' AND w.level = x.top JOIN leaves l ON l.doc_id = w.doc_id
JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM tl WHERE n = 1) t ON true
"""


@query
def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return cholesky_whitening.whiten(rows, cholesky_whitening.fit(rows))


@query
def op13_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_pii.find_personal(table(spark, sf_dir, "documents"))
