"""One query per operator, over its whole table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolanut.llm import alignment, decontamination, extraction, jaccard, language, manifest, mixing, nearest, quotes, sharding, substrings, token_counts, toxicity

TOKENIZER, BYTE_TOKENIZER = "piece_bpe_32k.model", "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under the public 32k piece model."""
    import public_tokenizers
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.n_bytes("text").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document so that sources come near their targets."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 13 words that an earlier one holds, as a digest of what is kept."""
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document dealt to 24 shards whose row counts are at most one apart."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order, linked by what they quote, without the quotes."""
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 85 % of their 4-word shingles."""
    return jaccard.join_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and where."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = language.remainder(F.col("doc_id"), 3) != 1
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn)
    held_out = F.coalesce(language.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = toxicity.score(docs.withColumn("held_out", held_out), model)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, language.remainder(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(language.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level and a piece vocabulary aligned over every text, and how usual their links are."""
    import public_tokenizers
    specs = alignment.read_specs(public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(TOKENIZER))
    aligned = alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), specs)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return alignment.supported(aligned.withColumn("groups_sha256", digest).drop("groups"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    out = extraction.extract(pages, extraction.train(pages))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; a fifth of them are tampered with before their proof is folded."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = {c: F.col(c) for c in docs.columns}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(language.remainder(F.col("doc_id"), 5) == 0, manifest.leaf(*(fields | {"text": lower}).values()))
    proofs = manifest.manifest(docs, leaf_of=manifest.leaf(*fields.values()), carry={"tampered": changed})
    folded = manifest.fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("steps")), 256).alias("proof_sha256"),
                        folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_QUERIES = (op1_token_counts, op2_nearest, op3_mixing, op4_substring_dedup, op5_sharding, op6_quotation_links, op7_jaccard_join, op8_decontamination, op9_toxicity, op10_language_id, op11_tokenizer_alignment, op12_html_extraction, op13_merkle_manifest)
QUERIES = {f.__name__: f for f in _QUERIES}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE: dict[str, str] = {
    "op2_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, min(sqrt(list_reduce([(q.e[i] - c.e[i]) * (q.e[i] - c.e[i]) for i in range(1, len(q.e) + 1)],
    lambda a, b: a + b))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e) GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run FROM p),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM m),
k AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
s AS (SELECT k.doc_id, string_agg(k.ws[k.i], ' ' ORDER BY k.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS gone
  FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.i = k.i GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id""",
    "op6_quotation_links": r"""
WITH RECURSIVE l AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
x AS (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, ls FROM l),
y AS (SELECT conv_id, turn, i, line, length(replace(regexp_extract(line, '^( ?>)+'), ' ', '')) AS level,
  trim(lower(regexp_replace(regexp_replace(line, '^( ?>)+', ''), '[ 	
]+', ' ', 'g'))) AS norm,
  length(regexp_extract(coalesce(ls[i + 1], ''), '^( ?>)+')) > 0 AS before_quote FROM x),
z AS (SELECT *, level = 0 AND NOT (before_quote AND regexp_matches(line, '^On .+ wrote:[ 	
]*$')) AS own FROM y),
b AS (SELECT conv_id, turn, regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (own), '^[ 	
]+|[ 	
]+$', '', 'g') AS body
  FROM z GROUP BY 1, 2),
q AS (SELECT DISTINCT conv_id, turn, level, norm FROM z WHERE level > 0 AND norm <> ''),
o AS (SELECT DISTINCT conv_id, turn, norm FROM z WHERE own AND norm <> ''),
m AS (SELECT q.conv_id, q.turn, q.level, q.norm, max(o.turn) AS parent FROM q JOIN o ON o.conv_id = q.conv_id AND o.norm = q.norm AND o.turn < q.turn
  GROUP BY 1, 2, 3, 4),
v AS (SELECT conv_id, turn, level, parent, count(*) AS votes FROM m GROUP BY 1, 2, 3, 4),
p AS (SELECT conv_id, turn, parent FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, parent DESC) = 1),
t AS (SELECT l.conv_id, l.turn, l.role, coalesce(p.parent, lag(l.turn) OVER w) AS parent,
  CASE WHEN p.parent IS NOT NULL THEN 'quote' WHEN lag(l.turn) OVER w IS NOT NULL THEN 'previous' END AS linked
  FROM l LEFT JOIN p USING (conv_id, turn) WINDOW w AS (PARTITION BY l.conv_id ORDER BY l.turn)),
r AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM t WHERE parent IS NULL
  UNION ALL SELECT t.conv_id, t.turn, r.root, r.depth + 1 FROM t JOIN r ON t.conv_id = r.conv_id AND t.parent = r.turn)
SELECT t.conv_id, t.turn, t.role, t.parent AS parent_turn, r.root AS root_turn, CAST(r.depth AS BIGINT) AS depth, t.linked,
  coalesce(b.body, '') AS body, row_number() OVER (PARTITION BY t.conv_id, r.root ORDER BY r.depth, t.turn) - 1 AS position
FROM t JOIN r USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)""",
    "op7_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM
  (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]) END AS gs FROM w),
n AS (SELECT doc_id, len(gs) AS n FROM g),
e AS (SELECT doc_id, unnest(gs) AS s FROM g),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.y AS component_id
FROM n JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) c ON c.x = n.doc_id""",
    "op13_merkle_manifest": """
WITH RECURSIVE crc(i, v) AS (SELECT i, CAST(list_reduce([CAST(i AS BIGINT)] || range(8),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc),
d AS (SELECT documents.*, row_number() OVER () AS id, 4294967295 - list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])) AS crc FROM documents, tab),
f AS (SELECT *, crc % 5 = 0 AS hit, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head FROM d),
l AS (SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN hit THEN sha256(head || coalesce(strlen(lower) || ':' || lower, '-')) END AS tampered FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM l),
s(source, lev, k, n, h) AS (SELECT source, 0, k, count(*) OVER (PARTITION BY source), leaf FROM k
  UNION ALL SELECT source, lev + 1, p, count(*) OVER (PARTITION BY source), h FROM
    (SELECT source, lev, k // 16 AS p, sha256(string_agg(h, '' ORDER BY k)) AS h FROM s WHERE n > 1 GROUP BY source, lev, k // 16)),
u AS (SELECT source, lev AS top, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM s WHERE n = 1),
t(lev, k, n, h) AS (SELECT 0, k, count(*) OVER (), subroot FROM u
  UNION ALL SELECT lev + 1, p, count(*) OVER (), h FROM (SELECT lev, k // 16 AS p, sha256(string_agg(h, '' ORDER BY k)) AS h FROM t WHERE n > 1 GROUP BY lev, k // 16)),
nodes AS (SELECT 0 AS tier, source, lev, k, h FROM s WHERE n > 1 UNION ALL SELECT 1, NULL, lev, k, h FROM t WHERE n > 1),
way AS (SELECT k.id, 0 AS tier, k.source, lev, k.k // CAST(pow(16, lev) AS BIGINT) AS k FROM k JOIN u ON u.source IS NOT DISTINCT FROM k.source, range(20) g(lev) WHERE lev < u.top
  UNION ALL SELECT k.id, 1, NULL, lev, u.k // CAST(pow(16, lev) AS BIGINT) FROM k JOIN u ON u.source IS NOT DISTINCT FROM k.source, range(20) g(lev)
    WHERE lev < (SELECT max(lev) FROM t)),
step AS (SELECT way.id, way.tier * 100 + way.lev AS pos, coalesce(string_agg(n.h, '' ORDER BY n.k) FILTER (n.k < way.k), '') AS before,
    coalesce(string_agg(n.h, '' ORDER BY n.k) FILTER (n.k > way.k), '') AS behind
  FROM way JOIN nodes n ON n.tier = way.tier AND n.lev = way.lev AND n.source IS NOT DISTINCT FROM way.source AND n.k // 16 = way.k // 16 GROUP BY way.id, way.tier, way.lev),
proof AS (SELECT id, string_agg(before || behind, '' ORDER BY pos) AS sibs, list({'a': before, 'b': behind} ORDER BY pos) AS steps FROM step GROUP BY id),
walk(id, i, h, steps) AS (SELECT k.id, 1, coalesce(tampered, leaf), coalesce(steps, []) FROM k LEFT JOIN proof USING (id)
  UNION ALL SELECT id, i + 1, sha256(steps[i].a || h || steps[i].b), steps FROM walk WHERE i <= len(steps))
SELECT k.doc_id, k.leaf, u.subroot, r.h AS root, sha256(coalesce(p.sibs, '')) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM k JOIN u ON u.source IS NOT DISTINCT FROM k.source CROSS JOIN (SELECT h FROM t WHERE n = 1) r
LEFT JOIN proof p ON p.id = k.id JOIN walk w ON w.id = k.id AND w.i = len(w.steps) + 1""",
}
