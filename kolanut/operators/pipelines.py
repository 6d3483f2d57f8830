"""The two whole runs: records into shards, and completions into report tables.

Stages meet in written tables, so a lost executor repeats one stage and not the run.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.lang import alias_lang, known_langs
from kolanut.functions.text import blocks
from kolanut.operators import joins, packing, rendering, sampling, validation
from kolanut.operators.aggregates import corpus_stats, report_table, summary
from kolanut.operators.frames import keep_rows, union_all
from kolanut.operators.scoring import VIDEO_CHECKS, enforce, quality_gate
from kolanut.sources.writers import write_shards


def build_corpus(records: DataFrame, seeds: DataFrame, root: str, holdout: DataFrame | None = None,
                 dup: Mapping[str, int] = t.DUP, max_per_type: int | None = None, vocab_size: int = t.VOCAB_SIZE,
                 cap: int = t.SHARD_TOKENS, gate: bool = True) -> dict[str, DataFrame]:
    """Join, validate, render, encode, upsample and pack; returns the reports.

    ``max_per_type`` caps each (type, language); the rows it drops are in the report ``capped``. Records and seeds come from ``sources.readers``. Held-out ids among the records stop the run, and
    so does a corpus that fails its gate.
    """
    spark = records.sparkSession

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    attached = stage(joins.attach_menu(records, seeds), "joined")
    if holdout is not None:  # over the ids that are left, each once
        joins.assert_no_leak(attached, holdout)
    checked = stage(validation.validate(validation.drop_flagged(joins.joined(attached))), "checked")
    shown = stage(rendering.render(validation.kept(checked)).select("id", "type", "lang", "segments", "_order"), "rendered")
    # input order: splits are the chunks, and a split holds a bounded number of rows
    split = F.struct("_order._wave", "_order._file", "_order._pos.block")
    able = shown.filter("segments IS NOT NULL")
    kept = able if max_per_type is None else sampling.cap_per_group(able, ["type", "lang"], "_order", max_per_type, split)
    pieces = stage(packing.drop_untrained(packing.with_pieces(kept)).select("id", "type", "lang", "pieces", "mask"), "pieces")
    if pieces.isEmpty():
        raise joins.GuardError("no renderable records")
    # pieces count as often as their copies will stand in the corpus, but are cut and encoded once
    times = F.array_repeat("pieces", sampling.copies_of(F.col("type"), dup))
    vocab = stage(packing.build_vocab(pieces.select(F.flatten(times).alias("pieces")), vocab_size), "vocab")
    coded = stage(packing.encode(pieces, vocab, "id").join(pieces.select("id", "type"), "id"), "encoded")
    examples = sampling.upsample(coded, dup).select(F.concat_ws("#", "id", "copy").alias("example_id"), "ids", "mask")
    manifest = write_shards(examples, root, cap)
    # measured, not declared: the ids that were given out, and the id that every example ends in
    found = vocab.agg((F.max("id") + 1).alias("vocab_size"), (F.count(F.lit(1)) + packing.FIRST_ID - len(packing.MARKERS)).alias("want")).first()
    ends = coded.agg(F.min(F.element_at("ids", -1)).alias("lo"), F.max(F.element_at("ids", -1)).alias("hi")).first()
    stats = corpus_stats(manifest).withColumns({
        "vocab_size": F.lit(found.vocab_size), "eos_id": F.lit(ends.lo if ends.lo == ends.hi else None).cast("int")})
    checks = quality_gate(stats, found.want)
    counts = able.groupBy("type", "lang").agg(F.count(F.lit(1)).alias("rows"))
    over = F.greatest(F.col("rows") - F.lit(max_per_type), F.lit(0)) if max_per_type is not None else F.lit(0)
    capped = counts.select("type", "lang", "rows", over.cast("bigint").alias("dropped"))
    if gate:
        enforce(checks)
    return {"join": joins.join_report(attached), "groups": joins.group_counts(attached),
            "rejects": validation.reject_report(checked), "rendered": rendering.render_report(shown),
            "capped": capped, "manifest": manifest, "stats": stats, "gate": checks}


# suite -> check column -> column of the comparison table
PROBE_COLUMNS = {
    "schema": {"right": "schema_right", "args_clean": "schema_args_clean"},
    "free": {"right": "free_right", "declined": "free_declined"},
    "patch": {"minimal": "patch_minimal", "preserved": "patch_preserved"},
    "abstain": {"abstained": "nocall_abstained"},
    "ask": {"asked": "disambig_asked"},
    "session": {"followed": "switch_followed", "kept_thread": "session_thread"},
    "language": {"stayed": "stayed_in_language"},
}


def probe_report(scored: Mapping[str, DataFrame]) -> DataFrame:
    """One row per model and one percentage per check, over the scored suites by name."""
    parts = []
    for suite, df in scored.items():
        cells = F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).alias("passed"))
                          for c, name in PROBE_COLUMNS[suite].items()])
        parts.append(df.select("model", F.explode(cells).alias("x")).select("model", "x.*"))
    names = [n for suite in scored for n in PROBE_COLUMNS[suite].values()]
    return report_table(union_all(parts), names)


def video_cases(records: DataFrame, holdout: DataFrame, limit: int = 150, seed: int = 7) -> DataFrame:
    """The held-out briefs to probe: known ids with a user turn and a menu, sequences sampled for
    a third. A language without a rule stops the run, as all its answers would count as failures."""
    held = records.join(holdout.select("id").distinct(), "id", "left_semi").filter("size(menu) > 0")
    pool = held.withColumn("question", blocks(F.col("output"), t.VIDEO_LABELS)["USER"]).select(
        "id", "lang", "menu", "question", F.col("input.brief").alias("brief"), F.col("input.shots").alias("shots"))
    pool = keep_rows(pool, F.coalesce(F.col("question"), F.lit("")) != "")
    known = records.sparkSession.createDataFrame([(x,) for x in known_langs()], "lang STRING")
    joins.assert_covered(pool.select(alias_lang(F.col("lang")).alias("lang")), known, "lang")
    return sampling.stratified_sample(pool, limit, seed=seed)


def video_report(scored: DataFrame) -> DataFrame:
    """A8 and A9 for the video checks: the rate per check, of all together, and of sequences."""
    every = F.lit(True)
    for c in VIDEO_CHECKS:
        every = every & F.coalesce(F.col(c), F.lit(False))
    rows = scored.withColumn("postable", every).withColumn("seq_shots", F.when(F.col("want_beats") > 1, F.col("shots")))
    held = F.count("seq_shots")
    return summary(rows, (*VIDEO_CHECKS, "postable"), more=(
        held.alias("sequences"), F.when(held > 0, 100.0 * F.count_if("seq_shots") / held).alias("sequence_shots")))
