"""Examples sampled, mixed, encoded and packed."""

from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.draws import draw
from kolanut.operators import merges, packing, sampling
from kolanut.operators.aggregates import corpus_stats
from kolanut.operators.frames import running_total
from kolanut.operators.rendering import render, renderable
from kolanut.operators.scoring import quality_gate
from kolanut.plans.base import OUTPUTS, blocks_sql, records, records_sql, table, texts
from kolanut.plans.rendering import _FLAT, _flat_sql
from kolanut.plans.seeding import SEED, d
from kolanut.sources import binary

KINDS = ("toolcall_api", "toolpatch", "toolrefuse", "tooldisambig")
VOCAB = 900
CAP = 100_000


def holdout_split(spark, sf):
    """400 documents held out, their ids renamed."""
    docs = table(spark, sf, "documents").select("doc_id", F.format_string("t6-sd-%05d", F.col("doc_id")).alias("id"))
    return sampling.split_holdout(docs, 400, SEED, ("t6-sd-", "t6-hold-")).select("doc_id", "id", "held_out")


def shuffle_positions(spark, sf):
    """The place of every order in the global shuffle, by a two-level running count."""
    o = table(spark, sf, "orders").select("o_orderkey").withColumn("dr", draw(18, F.col("o_orderkey"), "shuffle"))
    placed = running_total(o, [], ["dr", "o_orderkey"], F.lit(1), F.floor(F.col("dr") / F.lit(sampling.DRAW_CHUNK)), "position")
    return placed.select("o_orderkey", "position")


def shuffle_first(spark, sf):
    """G13 and a top-k: the first hundred orders of the shuffle."""
    return sampling.shuffle(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").limit(100)


def cap_per_group(spark, sf):
    """The first 700 order keys of each (status, priority), in key order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sampling.cap_per_group(o, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 700)


def stratified_sample(spark, sf):
    """150 documents, a third of them long ones."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 4000, 2).otherwise(1).alias("shots"))
    return sampling.stratified_sample(docs, 150)


def upsample(spark, sf):
    """T4: records of every type as often as their factor says."""
    return sampling.upsample(records(spark, sf).select("id", "type"))


def mixture(spark, sf):
    """T5: documents as the tools source and conversations as the replay source, 70 to 30 by characters."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    chat = table(spark, sf, "conversations").select((F.col("conv_id") * 16 + F.col("turn")).alias("id"),
                                                    F.length("text").cast("bigint").alias("n_chars"))
    mixed = sampling.mix({"tools": docs, "replay": chat}, t.MIX_WEIGHTS, "n_chars", "id")
    return mixed.select("source", "id", "n_chars")


def mixture_order(spark, sf):
    """T5: the same two sources as a sequence whose every beginning holds 70 to 30."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    chat = table(spark, sf, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"),
                                                    F.length("text").cast("bigint").alias("n_chars"))
    return sampling.interleave({"tools": docs, "replay": chat}, t.MIX_WEIGHTS, "n_chars", "id").select("position", "source", "id", "n_chars")


def _examples(spark, sf):
    r = renderable(render(records(spark, sf, KINDS)))
    return packing.with_pieces(r.select(F.col("id").alias("example_id"), "segments"))


def build_vocab(spark, sf):
    """The commonest pieces of the documents, with their ids."""
    docs = texts(spark, sf, "documents", "doc_id").select(packing.pieces(F.col("text")).alias("pieces"))
    return packing.build_vocab(docs, VOCAB).select("piece", F.col("id").cast("bigint").alias("id"))


def encode_mask(spark, sf):
    """Ids and loss mask per rendered example. Both the vocabulary and the ids cut the texts into pieces: kept, the pieces are
    many times the tables."""
    ex = _examples(spark, sf)
    coded = packing.with_counts(packing.encode(ex, packing.build_vocab(ex, VOCAB)))
    joined = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), " "))  # a cast is compiled, a lambda is not
    return coded.select("example_id", "n_tokens", "n_trained", joined("ids").alias("ids"), joined("mask").alias("mask"))


# a lexicon whose words are merged from their left ends: the tokens of the query, which no data decides
LEXICON = (" the and ing tion er en ed on in of to is that  de  la  que  el  los  und  der  die  das  ein  le  les  des  une"
           " ción  está ñ über für ß é è à ou an or re ti st nd th he at es as ar").replace("  ", " _").split()
MERGES = merges.chained(w.replace("_", " ") for w in LEXICON)


def encode_merges(spark, sf):
    """Sub-word ids of every message of every conversation."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.array(F.struct("text", (F.col("role") == "assistant").alias("train"))).alias("segments"))
    coded = packing.with_counts(merges.encode_merges(said, merges.merge_vocab(spark, MERGES), ["conv_id", "turn"]))
    return coded.select("conv_id", "turn", "n_tokens", "n_trained", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids"))


def _sized(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("source").alias("n_trained"))
    return packing.assign_shards(docs, "n_chars", "doc_id", CAP)


def pack_shards(spark, sf):
    return _sized(spark, sf).select("doc_id", "shard_id")


def shard_manifest(spark, sf):
    """The index of the packed shards."""
    return packing.manifest(_sized(spark, sf), "n_chars", "n_trained")


def shard_index(spark, sf):
    """The index rows of the packed shards as flat files."""
    return binary.index_rows(_sized(spark, sf).withColumnRenamed("n_chars", "n_tokens"))


def _trained(spark, sf):
    r = renderable(render(records(spark, sf)))
    return packing.drop_untrained(packing.with_pieces(r.select(F.col("id").alias("example_id"), "segments")))


def _stats():
    return (F.size("pieces") + 1).alias("n_tokens"), (F.size(F.filter("mask", lambda m: m == 1)) + 1).alias("n_trained")


def corpus_statistics(spark, sf):
    return corpus_stats(_trained(spark, sf).select(*_stats()))


def quality_gate_row(spark, sf):
    """The ids that the vocabulary gives out, the id that the encoded examples end in, and the trained share."""
    ex = _trained(spark, sf)
    vocab = packing.build_vocab(ex, VOCAB)
    vocab = spark.createDataFrame(vocab.collect(), vocab.schema)  # bounded; the examples are not, so they are cut again rather than kept
    coded = packing.encode(ex.withColumn("sizes", F.struct(*_stats())), vocab, "sizes").select("sizes.*", F.element_at("ids", -1).alias("last"))
    end = F.when(F.min("last") == F.max("last"), F.min("last")).alias("eos_id")
    stats = corpus_stats(coded, more=(end,)).withColumn("vocab_size", vocab.agg((F.max("id") + 1).alias("n")).scalar())
    return quality_gate(stats, VOCAB)


QUERIES = {
    "holdout_split": holdout_split, "shuffle_positions": shuffle_positions, "shuffle_first": shuffle_first,
    "cap_per_group": cap_per_group, "stratified_sample": stratified_sample, "upsample": upsample, "mixture": mixture, "mixture_order": mixture_order,
    "build_vocab": build_vocab, "encode_mask": encode_mask, "encode_merges": encode_merges, "pack_shards": pack_shards, "shard_manifest": shard_manifest, "shard_index": shard_index,
    "corpus_stats": corpus_statistics, "quality_gate": quality_gate_row,
}

_RX = "<reserved_[0-9]>|\\p{L}+|\\p{N}{1,3}|[^\\p{L}\\p{N}]"
_CASE = "CASE type " + " ".join(f"WHEN '{k}' THEN {_FLAT[k]}" for k in ("toolcall_api", "toolact", "seedance", "toolpatch", "toolrefuse", "tooldisambig")) + " END"


def _segments(kinds) -> str:
    """CTEs that end in ``seg`` (id, si, train, text): the flat text cut at its masks."""
    return f"""{records_sql(kinds)}, {blocks_sql()}, flat AS (SELECT id, {_CASE} AS flat FROM recs JOIN blk USING (id)),
cut AS (SELECT id, string_split(replace(replace(flat, '<0>', chr(1) || '0'), '<1>', chr(1) || '1'), chr(1))[2:] AS parts FROM flat WHERE flat IS NOT NULL),
seg AS (SELECT id, generate_subscripts(parts, 1) AS si, unnest(parts) AS part FROM cut),
toks AS (SELECT id, si, left(part, 1) AS m, regexp_extract_all(substr(part, 2), '{_RX}') AS ps FROM seg),
tok AS (SELECT id, si, m, generate_subscripts(ps, 1) AS pi, unnest(ps) AS piece FROM toks)"""


_MARKED = ", ".join(f"('{m}', {packing.MARKER_ID + i})" for i, m in enumerate(packing.MARKERS))
_VOCAB = (f"SELECT piece, row_number() OVER (ORDER BY n DESC, piece) + {packing.FIRST_ID - 1} AS id FROM "
          f"(SELECT piece, count(*) AS n FROM tok WHERE piece NOT IN (SELECT piece FROM (VALUES {_MARKED}) AS m(piece, id)) "
          f"GROUP BY 1 ORDER BY n DESC, piece LIMIT {VOCAB - packing.FIRST_ID}) UNION ALL SELECT * FROM (VALUES {_MARKED}) AS m(piece, id)")
_PLACED = f"""WITH RECURSIVE p AS (SELECT doc_id, n_chars, length(source) AS n_trained,
      CAST(sum(coalesce(n_chars, 0)) OVER (ORDER BY {d('doc_id', "'shuffle'", 18)}, doc_id) AS BIGINT) AS e FROM documents),
    cuts(z) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT min(p.e) FROM cuts, p WHERE p.e >= cuts.z + {CAP} HAVING min(p.e) IS NOT NULL),
    c AS (SELECT list(z) AS ends FROM cuts WHERE z > 0)
    SELECT doc_id, n_chars, n_trained, CAST(len(list_filter(coalesce(ends, []), lambda x: x <= e - coalesce(n_chars, 0))) AS BIGINT) AS shard_id FROM p, c"""
_MIXED = lambda name: (f"CAST('0x' || substr(md5('18:{name}:' || CAST(id AS VARCHAR) || ':mix'), 1, 8) AS BIGINT) < "
                       f"least(1.0, CAST(b AS DOUBLE) * {t.MIX_WEIGHTS[name]} / 100 / have) * 4294967296")
_COUNTED = """cnt AS (SELECT id, count(*) + 1 AS n_tokens, count(*) FILTER (m = '1') + 1 AS n_trained FROM tok GROUP BY id)"""
# sessions are cut from their own flat text, so the statistics cover every type
_ALL_TOK = ("WITH " + "flat AS (" + " UNION ALL ".join(f"SELECT id, flat FROM ({_flat_sql(k, tuple(OUTPUTS))})" for k in t.TYPES) + "), " +
            f"""cut AS (SELECT id, string_split(replace(replace(flat, '<0>', chr(1) || '0'), '<1>', chr(1) || '1'), chr(1))[2:] AS parts FROM flat WHERE flat IS NOT NULL),
seg AS (SELECT id, unnest(parts) AS part FROM cut),
cnt AS (SELECT id, sum(len(regexp_extract_all(substr(part, 2), '{_RX}'))) + 1 AS n_tokens,
  coalesce(sum(len(regexp_extract_all(substr(part, 2), '{_RX}'))) FILTER (left(part, 1) = '1'), 0) + 1 AS n_trained FROM seg GROUP BY id),
st AS (SELECT count(*) AS examples, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_trained) AS BIGINT) AS trained,
  round(CAST(sum(n_trained) AS DOUBLE) / sum(n_tokens), 4) AS response_frac FROM cnt)""")
_HEX = [(a.hex().upper(), b.hex().upper()) for a, b in MERGES]
_MERGE_LIST = ", ".join(f"'{a}|{b}'" for a, b in _HEX)
_MERGED_LIST = ", ".join(f"'{a}{b}'" for a, b in _HEX)
ORACLE = {
    "holdout_split": f"""WITH x AS (SELECT doc_id, 't6-sd-' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS id FROM documents),
        r AS (SELECT *, row_number() OVER (ORDER BY {d('id', "'holdout'")}, id) AS rn FROM x)
        SELECT doc_id, CASE WHEN rn <= 400 THEN replace(id, 't6-sd-', 't6-hold-') ELSE id END AS id, rn <= 400 AS held_out FROM r""",
    "shuffle_positions": f"SELECT o_orderkey, row_number() OVER (ORDER BY {d('o_orderkey', repr('shuffle'), 18)}, o_orderkey) - 1 AS position FROM orders",
    "shuffle_first": f"SELECT o_orderkey FROM orders ORDER BY {d('o_orderkey', repr('shuffle'), 18)}, o_orderkey LIMIT 100",
    "cap_per_group": """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER
        (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 700""",
    "stratified_sample": f"""WITH x AS (SELECT doc_id AS id, CAST(CASE WHEN n_chars > 4000 THEN 2 ELSE 1 END AS INTEGER) AS shots, n_chars > 4000 AS is_seq,
        row_number() OVER (PARTITION BY n_chars > 4000 ORDER BY {d('doc_id', repr('sample'), 7)}, doc_id) AS rn FROM documents),
        q AS (SELECT least(count(*) FILTER (is_seq), 50) AS s FROM x)
        SELECT id, shots, is_seq FROM x, q WHERE rn <= CASE WHEN is_seq THEN 50 ELSE 150 - s END""",
    "upsample": f"""WITH {records_sql()} SELECT id, type, CAST(unnest(range(1, CASE type
        {' '.join(f"WHEN '{k}' THEN {n + 1}" for k, n in t.DUP.items())} END)) AS INTEGER) AS copy FROM recs""",
    "mixture": f"""WITH a AS (SELECT doc_id AS id, n_chars FROM documents), c AS (SELECT conv_id * 16 + turn AS id, length(text) AS n_chars FROM conversations),
        h AS (SELECT (SELECT sum(n_chars) FROM a) AS ha, (SELECT sum(n_chars) FROM c) AS hc), bb AS (SELECT *, least(ha * 100 // 70, hc * 100 // 30) AS b FROM h)
        SELECT 'tools' AS source, id, n_chars FROM (SELECT *, ha AS have FROM a, bb) WHERE {_MIXED('tools')}
        UNION ALL SELECT 'replay', id, n_chars FROM (SELECT *, hc AS have FROM c, bb) WHERE {_MIXED('replay')}""",
    "mixture_order": f"""WITH u AS (SELECT 'tools' AS source, doc_id AS id, n_chars FROM documents UNION ALL
          SELECT 'replay', conv_id * 100000 + turn, length(text) FROM conversations),
        x AS (SELECT *, {d("source || ':' || id", "'line'", 18)} AS dr FROM u),
        p AS (SELECT *, CASE source WHEN 'tools' THEN {t.MIX_WEIGHTS['replay']} ELSE {t.MIX_WEIGHTS['tools']} END *
          (sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY dr, id, n_chars) - coalesce(n_chars, 0)) AS tm FROM x),
        e AS (SELECT min(z) AS z FROM (SELECT CASE source WHEN 'tools' THEN {t.MIX_WEIGHTS['replay']} ELSE {t.MIX_WEIGHTS['tools']} END * sum(n_chars) AS z FROM u GROUP BY source))
        SELECT row_number() OVER (ORDER BY tm, source, dr, id) - 1 AS position, source, id, n_chars FROM p, e WHERE tm < z""",
    "build_vocab": f"WITH tok AS (SELECT unnest(regexp_extract_all(text, '{_RX}')) AS piece FROM documents) {_VOCAB}",
    "encode_mask": f"""WITH {_segments(KINDS)}, vocab AS ({_VOCAB}),
        h AS (SELECT t.id, si, pi, m, v.id AS vid, hex(encode(piece)) AS hx FROM tok t LEFT JOIN vocab v USING (piece)),
        b AS (SELECT id, si, pi, m, CASE WHEN vid IS NOT NULL THEN [vid] ELSE
          [CAST('0x' || hx[2 * i - 1:2 * i] AS BIGINT) + {packing.BYTE_ID} for i in range(1, len(hx) // 2 + 1)] END AS part FROM h),
        c AS (SELECT id, si, pi, m, unnest(part) AS pid, generate_subscripts(part, 1) AS bi FROM b)
        SELECT id AS example_id, CAST(count(*) + 1 AS INTEGER) AS n_tokens, CAST(count(*) FILTER (m = '1') + 1 AS INTEGER) AS n_trained,
        md5(string_agg(CAST(pid AS VARCHAR), ' ' ORDER BY si, pi, bi) || ' {t.EOS_ID}') AS ids,
        md5(string_agg(m, ' ' ORDER BY si, pi, bi) || ' 1') AS mask FROM c GROUP BY id""",
    "encode_merges": f"""WITH ws AS (SELECT conv_id, turn, role, regexp_extract_all(text, '{merges.WORDS}') AS ws FROM conversations),
        one AS (SELECT conv_id, turn, role, generate_subscripts(ws, 1) AS wi, unnest(ws) AS word FROM ws),
        dw AS (SELECT word, regexp_replace(hex(encode(word)), '(..)', chr(2) || '\\1' || chr(3), 'g') AS s FROM (SELECT DISTINCT word FROM one)),
        mg AS (SELECT word, list_reduce([s] || [{_MERGE_LIST}], lambda acc, m: replace(acc, chr(2) || split_part(m, '|', 1) || chr(3) || chr(2)
          || split_part(m, '|', 2) || chr(3), chr(2) || replace(m, '|', '') || chr(3))) AS s FROM dw),
        ids AS (SELECT word, list_transform(string_split(s[2:-2], chr(3) || chr(2)), lambda p: CASE WHEN length(p) = 2
          THEN CAST('0x' || p AS BIGINT) + {packing.BYTE_ID} ELSE list_position([{_MERGED_LIST}], p) + {packing.FIRST_ID - 1} END) AS ids FROM mg),
        cat AS (SELECT conv_id, turn, role, flatten(list(ids ORDER BY wi)) AS ids FROM one JOIN ids USING (word) GROUP BY ALL),
        al AS (SELECT c.conv_id, c.turn, c.role, coalesce(cat.ids, []) AS ids FROM conversations c LEFT JOIN cat USING (conv_id, turn))
        SELECT conv_id, turn, CAST(len(ids) + 1 AS INTEGER) AS n_tokens, CAST(CASE role WHEN 'assistant' THEN len(ids) ELSE 0 END + 1 AS INTEGER) AS n_trained,
        md5(array_to_string(ids || [{t.EOS_ID}], ' ')) AS ids FROM al""",
    "pack_shards": f"SELECT doc_id, shard_id FROM ({_PLACED})",
    "shard_manifest": f"""SELECT shard_id, count(*) AS examples, CAST(sum(n_chars) AS BIGINT) AS n_tokens,
        CAST(sum(n_trained) AS BIGINT) AS n_trained FROM ({_PLACED}) GROUP BY 1""",
    "shard_index": f"""SELECT shard_id, format('shard_{{:05d}}.bin', shard_id) AS file, format('mask_{{:05d}}.bin', shard_id) AS mask, count(*) AS examples,
        CAST(sum(n_chars) AS BIGINT) AS n_tokens, CAST(sum(n_trained) AS BIGINT) AS n_trained,
        round(CAST(sum(n_trained) AS DOUBLE) / greatest(sum(n_chars), 1), 4) AS response_frac FROM ({_PLACED}) GROUP BY 1""",
    "corpus_stats": f"{_ALL_TOK} SELECT * FROM st",
    "quality_gate": f"{_ALL_TOK}, tok AS (SELECT unnest(regexp_extract_all(substr(part, 2), '{_RX}')) AS piece FROM seg), vocab AS ({_VOCAB}) "
        f"SELECT (SELECT max(id) + 1 = {VOCAB} FROM vocab) AS vocab_ok, true AS eos_ok, response_frac > 0.05 AND response_frac < 0.60 AS response_frac_ok FROM st",
}
