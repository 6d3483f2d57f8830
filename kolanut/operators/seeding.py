"""Synthetic jobs. Every row is a pure function of its number, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions import menus
from kolanut.functions.draws import choice, draw, round_robin, scaled, unit, weighted_of, wide_draw
from kolanut.operators.frames import keep_rows, running_total, union_all

INLINE_TERMS = 1000


def spine(spark: SparkSession, n: int, prefix: str) -> DataFrame:
    """G1: ``i`` and the zero-padded ``id``."""
    return with_ids(spark.range(n).withColumnRenamed("id", "i"), prefix)


def with_ids(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("id", F.format_string(f"{prefix}-%05d", F.col("i")))


# --- weighted draws -------------------------------------------------------------------------------
def _positive(weights: DataFrame, term: str = "term", n: str = "n") -> DataFrame:
    terms = weights.select(F.col(term).alias("term"), F.col(n).cast("bigint").alias("n")).filter("n > 0")
    return terms.withColumn("_d", draw(0, F.col("term"), "weights"))


def inline(weights: DataFrame, term: str = "term", n: str = "n") -> Column:
    """The interval table [lo, hi) as one ARRAY value, for the dictionary-sized tables of a grammar.

    The terms lie in the same order as in ``weighted_choice``, so both give a draw the same term. The dictionary bounds a
    grammar: at most INLINE_TERMS + 1 positive terms are ever gathered, and a larger table is an error, not a cut.
    """
    rows = _positive(weights, term, n).limit(INLINE_TERMS + 1)
    rows = rows.withColumn("hi", F.sum("n").over(Window.orderBy("_d", "term"))).select("term", (F.col("hi") - F.col("n")).alias("lo"), "hi")
    too_many = F.raise_error(F.lit(f"more than {INLINE_TERMS} terms: use weighted_choice"))
    terms = F.sort_array(F.collect_list(F.struct("lo", "hi", "term")))
    return rows.agg(F.when(F.count(F.lit(1)) > INLINE_TERMS, too_many).otherwise(terms).alias("w")).scalar()


def weighted_choice(df: DataFrame, weights: DataFrame, out: str, d: Column, empty: str | None = t.EMPTY_GRAMMAR_TERM) -> DataFrame:
    """A term in proportion to its weight, for a wide draw ``d``; ``empty`` where the table holds no positive weight.

    Rows and terms meet through an equi-join on slices of the weight range. There are about as many slices as terms, so a
    row is compared with two terms on average, and a heavy term is spread over many slices.
    """
    keyed = _positive(weights)
    rows = running_total(keyed, [], ["_d", "term"], F.col("n"), F.floor(F.col("_d") / F.lit(1 << 16)), "lo")
    rows = rows.select("term", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    total = keyed.agg(F.sum("n").cast("bigint").alias("s")).scalar()
    step = keyed.agg(F.greatest(F.ceil(F.sum("n") / F.count(F.lit(1))), F.lit(1)).cast("bigint").alias("s")).scalar()
    sliced = rows.select("*", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("_slice"))
    drawn = df.withColumn("_u", scaled(d, total)).withColumn("_slice", F.floor(F.col("_u") / step))
    hit = (drawn["_slice"] == sliced["_slice"]) & (F.col("lo") <= F.col("_u")) & (F.col("_u") < F.col("hi"))
    return drawn.join(sliced, hit, "left").select(*[c for c in df.columns if c != out], F.coalesce("term", F.lit(empty)).alias(out))


def pair_choice(df: DataFrame, pairs: Column, left: Column, right: Column, seed: int, key: str = "id",
                p: float = 0.72, names: tuple[str, str] = ("shot", "move")) -> DataFrame:
    """Both terms from one co-occurring pair with probability p, else drawn apart.

    ``pairs``, ``left`` and ``right`` are columns of interval arrays as ``inline`` makes them.
    """
    k = F.col(key)
    held = df.withColumns({"_p": pairs, "_l": left, "_r": right})
    held = held.withColumn("_both", F.split(weighted_of(wide_draw(seed, k, "pair"), F.col("_p")), r"\|"))
    paired = F.col("_both").isNotNull() & (unit(draw(seed, k, "paired")) < p)
    alone = lambda terms, why: F.coalesce(weighted_of(wide_draw(seed, k, why), F.col(terms)), F.lit(t.EMPTY_GRAMMAR_TERM))
    return held.withColumns({
        names[0]: F.when(paired, F.get(F.col("_both"), F.lit(0))).otherwise(alone("_l", "left")),
        names[1]: F.when(paired, F.get(F.col("_both"), F.lit(1))).otherwise(alone("_r", "right")),
    }).drop("_p", "_l", "_r", "_both")


# --- tool jobs ------------------------------------------------------------------------------------
def make_menu(df: DataFrame, k: Column, seed: int, key: str = "id") -> DataFrame:
    """Adds ``style``, ``concepts`` and ``menu``."""
    return (df.withColumn("style", menus.style_of(seed, F.col(key)))
            .withColumn("concepts", menus.concepts_of(seed, F.col(key), k))
            .withColumn("menu", menus.tools_of(seed, F.col(key), F.col("style"), F.col("concepts"))))


def pick_target(df: DataFrame, seed: int, pool=None, key: str = "id") -> DataFrame:
    """Adds ``target``; null when no weighted concept is on the menu."""
    pick = menus.pick_concept(seed, F.col(key), F.col("concepts"), *([] if pool is None else [pool]))
    return df.withColumn("_c", pick).withColumn("target", menus.tool_name(F.col("style"), F.col("_c"))).drop("_c")


def _base(df: DataFrame, kind: str, phase: int, seed: int, k: Column | None = None, langs=t.NG * 2 + t.LANGS) -> DataFrame:
    out = make_menu(df, F.lit(6) if k is None else k, seed)
    return out.withColumns({
        "type": F.lit(kind), "phase": F.lit(phase), "lang": choice(draw(seed, F.col("id"), "lang"), langs),
        "menu_id": F.concat_ws("-", "style", "id")})


def api_jobs(df: DataFrame, seed: int, phase: int = 5) -> DataFrame:
    jobs = pick_target(_base(df, "toolcall_api", phase, seed), seed)
    first = menus.tool_name(F.col("style"), F.get(F.col("concepts"), F.lit(0)))
    return jobs.withColumn("target", F.coalesce("target", first)).withColumn("domain", F.lit("Nigerian fintech"))


def patch_jobs(df: DataFrame, seed: int, phase: int = 5, wave: int = 2) -> DataFrame:
    transfer = menus.tool_name(F.col("style"), F.lit("transfer"))
    return _base(df, "toolpatch", phase, seed).withColumns({
        "current": menus.pending_call(F.col("menu"), transfer, wave),
        "edit_kind": choice(draw(seed, F.col("id"), "edit"), t.EDITS)})


def refuse_jobs(df: DataFrame, seed: int, phase: int = 5) -> DataFrame:
    return _base(df, "toolrefuse", phase, seed).withColumn("mode", round_robin(F.col("i"), t.MODES))


def disambig_jobs(df: DataFrame, seed: int, phase: int = 5) -> DataFrame:
    pick = choice(draw(seed, F.col("id"), "target"), F.transform("menu", lambda x: x["name"]))
    return _base(df, "tooldisambig", phase, seed).withColumns({
        "target": pick, "ambiguity": choice(draw(seed, F.col("id"), "ambiguity"), t.AMBIGUITIES)})


def act_jobs(df: DataFrame, seed: int, phase: int = 7) -> DataFrame:
    """Rows whose menu holds no weighted concept keep a null target: ``drop_untargeted`` counts on it."""
    k = choice(draw(seed, F.col("id"), "menu_size"), t.MENU_SIZES)
    jobs = _base(df, "toolact", phase, seed, k, t.NG * 3 + t.LANGS)
    return pick_target(jobs, seed, menus._ACT_POOL)


def drop_untargeted(jobs: DataFrame) -> DataFrame:
    return keep_rows(jobs, F.col("target").isNotNull())


def session_jobs(df: DataFrame, seed: int, phase: int = 6) -> DataFrame:
    key = F.col("id")
    k = choice(draw(seed, key, "menu_size"), t.MENU_SIZES)
    n = choice(draw(seed, key, "turns"), t.SESSION_TURNS)
    jobs = _base(df, "toolsession", phase, seed, k).withColumns({
        "langs": menus.lang_sequence(seed, key, n), "shape": choice(draw(seed, key, "shape"), t.SHAPES)})
    return jobs.withColumn("lang", F.get(F.col("langs"), F.lit(0)))


def tool_jobs(spark: SparkSession, n_per_type: int, seed: int = 20260919) -> DataFrame:
    """The first wave: n jobs of each of four types."""
    make = {"t2-api": api_jobs, "t2-patch": patch_jobs, "t2-ref": refuse_jobs, "t2-dis": disambig_jobs}
    return union_all([f(spine(spark, n_per_type, p), seed) for p, f in make.items()])


_BALANCE = {"toolcall_api": ("t5-api", api_jobs), "toolpatch": ("t5-patch", lambda d, s, phase: patch_jobs(d, s, phase, 5)),
            "toolrefuse": ("t5-ref", refuse_jobs), "toolsession": ("t5-sess", session_jobs)}


def shortfall(df: DataFrame, target: Mapping[str, int], key: str = "type") -> dict[str, int]:
    """Rows each type still lacks; one count per wanted type comes to the driver."""
    have = {r[key]: r["n"] for r in df.filter(F.col(key).isin(*target)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {kind: max(0, n - have.get(kind, 0)) for kind, n in target.items()}


def balance_jobs(spark: SparkSession, want: Mapping[str, int] = t.WANT, seed: int = 20260921, phase: int = 8) -> DataFrame:
    """The second wave, as many rows per type as wanted."""
    return union_all([_BALANCE[kind][1](spine(spark, n, _BALANCE[kind][0]), seed, phase) for kind, n in want.items()])


def balance(df: DataFrame, target: Mapping[str, int], seed: int = 20260921) -> DataFrame:
    """Existing jobs topped up to the target per type."""
    return union_all([df, balance_jobs(df.sparkSession, shortfall(df, target), seed)])


# --- video jobs -----------------------------------------------------------------------------------
def with_grammar(df: DataFrame, grammar: DataFrame) -> DataFrame:
    """Adds one interval array per group (``_g_shot`` ... ``_g_pair``) from the (grp, term, n) table.

    The grammar is bounded by the dictionary, so each array is a single small value of the plan.
    """
    groups = (*t.DICTIONARY, "pair")
    return df.withColumns({f"_g_{g}": inline(grammar.filter(F.col("grp") == g)) for g in groups})


def video_rows(df: DataFrame, grammar: DataFrame, seed: int, wave: int = 1) -> DataFrame:
    """G10/G11 over rows that carry ``i`` and ``id``. Wave 2 asks for up to four shots."""
    key, g = F.col("id"), {x: F.col(f"_g_{x}") for x in (*t.DICTIONARY, "pair")}
    langs = t.NG * 3 + t.VIDEO_TAIL if wave == 1 else t.VIDEO_FOCUS * 4 + t.NG
    alone = lambda group: F.coalesce(weighted_of(wide_draw(seed, key, group), g[group]), F.lit(t.EMPTY_GRAMMAR_TERM))
    jobs = pair_choice(with_grammar(df, grammar), g["pair"], g["shot"], g["move"], seed).withColumns({
        "type": F.lit("seedance"), "phase": F.lit(9 if wave == 1 else 10), "target": F.lit(t.VIDEO_TOOL),
        "lang": choice(draw(seed, key, "lang"), langs), "menu": menus.video_menu(seed, key),
        "menu_id": F.concat_ws("-", F.lit("sd" if wave == 1 else "sd7"), F.col("i").cast("string")),
        "angle": alone("angle"), "time": alone("time"),
    })
    d = draw(seed, key, "brief")
    if wave == 1:
        jobs = jobs.withColumn("brief", choice(d, t.BRIEFS))
    else:
        many = choice(draw(seed, key, "shots"), t.SEQUENCE_SHOTS)
        jobs = jobs.withColumn("shots", F.when(unit(draw(seed, key, "sequence")) < 0.62, many).otherwise(1))
        sequence = F.col("shots") > 1

        def other(chosen: str, why: str) -> Column:
            names = F.filter(F.transform(g[chosen], lambda x: x["term"]), lambda x: x != F.col(chosen))
            return F.when(sequence, F.coalesce(choice(draw(seed, key, why), names), F.col(chosen)))

        jobs = jobs.withColumns({
            "brief": F.when(sequence, choice(d, t.SEQUENCE_BRIEFS)).otherwise(choice(d, t.SINGLE_BRIEFS)),
            "shot2": other("shot", "shot2"), "move2": other("move", "move2")})
    return jobs.drop(*[f"_g_{x}" for x in g])


def video_jobs(spark: SparkSession, n: int, grammar: DataFrame, wave: int = 1, seed: int | None = None) -> DataFrame:
    seed = seed if seed is not None else (20260922 if wave == 1 else 20260923)
    return video_rows(spine(spark, n, "t6-sd" if wave == 1 else "t7-sd"), grammar, seed, wave)


def grammar_table(spark: SparkSession, vocab: Mapping[str, Mapping[str, int]], pairs: Mapping[str, int]) -> DataFrame:
    """A stored grammar as the (grp, term, n) table the draws read."""
    rows = [(g, term, int(n)) for g, terms in vocab.items() for term, n in terms.items()]
    rows += [("pair", pair, int(n)) for pair, n in pairs.items()]
    return spark.createDataFrame(rows, "grp STRING, term STRING, n BIGINT")
