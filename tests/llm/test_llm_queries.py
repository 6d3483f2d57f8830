"""The ten queries against their SQL twins, and the pipeline against brute force, at the smallest scale."""

import os

import duckdb
import pytest
import re

import corpus_pipeline as pipeline
from kolanut.llm import queries
from test_jaccard import brute as groups_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(queries.ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert _sorted(tuple(r[c] for c in cols) for r in df.collect()) == _sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_every_query_reads_every_row(spark, duck):
    n = duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    for name in ("op1_token_counts", "op3_mixing", "op5_sharding", "op9_toxicity", "op10_language_id", "op11_tokenizer_alignment", "op13_merkle_manifest"):
        df = queries.QUERIES[name](spark, SF)
        ids = [r.doc_id for r in df.select("doc_id").collect()]
        assert len(ids) == n == len(set(ids)), name


def test_leaks_are_the_planted_ones(spark, duck):
    clean = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    docs, items = duck.sql("SELECT doc_id, text FROM documents").fetchall(), duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    want = {(d, i) for d, t in docs for i, x in items if f" {clean(x)} " in f" {clean(t)} "}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontamination"](spark, SF).collect()}
    assert want and want <= got


def test_pipeline_stages(spark, duck):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    spoken = rows(stages["language"](spark, docs, SF))
    assert set(spoken) == set(rows(docs))  # all planted texts are in a language
    groups = groups_of([(d, r.text) for d, r in spoken.items()], 5, 80)
    kept = stages["near_copies"](spark, docs, SF)
    assert sorted(rows(kept)) == sorted(d for _, d, _, c in groups if c == d)
    assert kept.columns == docs.columns
    leaks = {r.doc_id for r in queries.QUERIES["op8_decontamination"](spark, SF).collect()}
    assert set(rows(stages["benchmark"](spark, docs, SF))) == set(rows(docs)) - leaks
    copies = {r.doc_id: r.copies for r in queries.QUERIES["op3_mixing"](spark, SF).collect()}
    mixed = [r.doc_id for r in stages["mixture"](spark, docs, SF).collect()]
    assert sorted(mixed) == sorted(d for d, n in copies.items() for _ in range(n))
    dealt = stages["shards"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in dealt) == sorted(rows(docs)) and len({(r.shard, r.slot) for r in dealt}) == len(dealt)


def test_pipeline_runs_whole(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(sizes) == out.count() and max(sizes) - min(sizes) <= 1


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f", "en", None, 11), (2, "a b c d e f", "en", None, 11),
            (None, "the same words again here", "en", "s", 3), (3, "un deux trois quatre cinq six", "fr", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 18
        assert stage(spark, docs.limit(0), SF).count() == 0
    alone = [r.doc_id for r in dict(pipeline.STAGES)["near_copies"](spark, docs, SF).collect()]
    assert sorted(alone, key=str) == [0, 1, 2, 3, None]


def test_near_copies_are_dropped_by_row(spark):
    """Other texts under one doc_id are rows of their own: only the copies among them go."""
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcde"}
    rows = [(1, text["a"]), (2, text["a"] + " more"), (2, text["b"]), (2, text["c"]), (3, text["b"]), (4, text["d"]), (4, text["d"]),
            (4, None), (None, text["a"]), (5, text["e"]), (5, text["e"] + " more")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in dict(pipeline.STAGES)["near_copies"](spark, docs.repartition(3), SF).collect()]
    fives = [t for d, t in got if d == 5]
    assert len(fives) == 1 and fives[0].startswith(text["e"])
    want = [(1, text["a"]), (2, text["b"]), (2, text["c"]), (4, text["d"]), (4, None), (None, text["a"])]
    assert sorted((r for r in got if r[0] != 5), key=str) == sorted(want, key=str)


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı.",
    "junk": "xkqz vbnt pwrtz gkdfl qqxv zzkr mwvtx bnpq rtkl xzvv dfgk hjkl wqpt xcvb nmkl trpq zxkv bbdf",
    "base64": "dGhpc0lzTm90QVRleHRBdEFsbFhZWjAxMjM0NTY3ODlxd2VydHl1aW9wQVNERkdIamtsWlhDVkJOTXF3ZXJ0eVFXRVJUWVVJT1A",
    "hex": "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08e3b0c44298fc1c149afbf4c8996fb924",
}


def test_foreign_and_junk_texts_go_and_clean_short_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = [(9000 + i, t, "en", "s", 1) for i, t in enumerate(["The and of.", "That it.", "Von der und.", "De la.", "Une et des.", "El de los."])]
    odd = [(8000 + i, t * n, None, "s", 1) for i, t in enumerate(FOREIGN.values()) for n in (1, 30)]
    planted = spark.createDataFrame([*short, *odd, (9100, "12 34 !!", "en", "s", 1)], docs.schema)
    model_ids = {r.doc_id for r in docs.select("doc_id").collect()}
    got = [r.doc_id for r in dict(pipeline.STAGES)["language"](spark, docs.unionByName(planted), SF).collect()]
    assert sorted(got) == sorted([*model_ids, *(r[0] for r in short)])
