"""Declared schemas, no inference, input order kept as columns.

``_wave``, ``_file`` and ``_pos`` give every row its place in the input: rows of one file are ordered
by ``_pos``, files by name, and the given paths by their position in the list.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolanut import schemas
from kolanut.operators.frames import union_all
from kolanut.operators.merges import TOKENS
from kolanut.sources.arrays import RANGE, read_array


def _placed(df: DataFrame, wave: int = 0) -> DataFrame:
    """Input position. A split's rows keep their order, and a split starts at its block."""
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", F.lit(wave).alias("_wave"), F.col("_metadata.file_path").alias("_file"), pos.alias("_pos"))


def read_seeds(spark: SparkSession, paths: Sequence[str], span: int = RANGE) -> DataFrame:
    """JSON-array seed files, one wave per path; ``joins.last_wave`` picks the winner per id.

    A file is cut at element borders, so its size does not bound the tasks. An element that is no object has null fields.
    """
    waves = []
    for i, p in enumerate(paths):
        rows = read_array(spark, p, span).select(
            F.from_json("value", schemas.SEEDS).alias("_seed"), F.lit(i).alias("_wave"), "_file",
            F.struct(F.col("_at").alias("block"), F.lit(0).cast("bigint").alias("row")).alias("_pos"))
        waves.append(rows.select("_seed.*", "_wave", "_file", "_pos"))
    return union_all(waves)


_TEXTS = "id STRING, type STRING, lang STRING, output STRING, input STRING, degenerate STRING, empty STRING, menu STRING"


def _truth(text: Column) -> Column:
    """A flag as any JSON value reads as true or false."""
    return F.when(text.isNotNull(), ~F.lower(F.trim(text)).isin("false", "0", "0.0", "", "null", "[]", "{}"))


def _whole(text: Column) -> Column:
    """A whole number, however it was written."""
    return text.try_cast("double").try_cast("int")


def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records from JSON text, one per row; other columns stay.

    Every value is taken as text first, so a number in quotes or a flag as 0 is read and loses nothing. Only text that is
    not JSON keeps its line in ``_corrupt``. Fields that are not declared, and ``input`` as it was written, are in
    ``_rest``.
    """
    line = F.col(value)
    read = F.from_json(line, f"{_TEXTS}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    declared = [f.split(" ")[0] for f in _TEXTS.split(", ") if not f.startswith("input")]
    rest = F.map_filter(F.from_json(line, "MAP<STRING, STRING>"), lambda k, v: ~k.isin(*declared))
    rows = lines.withColumns({"_r": read, "_rest": rest})
    given = F.from_json("_r.input", "target STRING, current STRING, brief STRING, shots STRING")
    rows = rows.withColumn("_i", given)
    return rows.select(
        "_r.id", "_r.type", "_r.lang", "_r.output",
        F.when(F.col("_i").isNotNull(), F.struct("_i.target", "_i.current", "_i.brief", _whole(F.col("_i.shots")).alias("shots"))).alias("input"),
        _truth(F.col("_r.degenerate")).alias("degenerate"), _truth(F.col("_r.empty")).alias("empty"),
        F.from_json("_r.menu", schemas.MENU).alias("menu"), "_rest", "_r._corrupt",
        *[c for c in lines.columns if c != value])


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """JSONL records; blank lines vanish, a line that is not JSON keeps its text in ``_corrupt``."""
    waves = [_placed(spark.read.text(p), i) for i, p in enumerate(paths)]
    return parse_records(union_all(waves).filter(F.trim(F.regexp_replace("value", r"\s", "")) != ""))


def read_staged(spark: SparkSession, root: str) -> DataFrame:
    """S3: ``type=/lang=`` partitions; both columns come from the path and prune the scan."""
    body = ", ".join(f for f in (
        "id STRING", "output STRING", f"input {schemas.INPUT}", "degenerate BOOLEAN", "empty BOOLEAN",
        f"menu {schemas.MENU}", "type STRING", "lang STRING"))
    return spark.read.schema(body).json(root)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.jsonl`` below a folder, as ``read_records`` reads a file."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    return parse_records(lines.filter(F.trim(F.regexp_replace("value", r"\s", "")) != ""))


def read_scripts(spark: SparkSession, path: str, n: int | None = None, key: str = "script_id") -> DataFrame:
    """A Parquet table of scripts; the first n by key when n is given."""
    df = spark.read.parquet(path)
    return df if n is None else df.orderBy(key).limit(n)


def read_menu(spark: SparkSession, path: str, drop: Sequence[str] = ("aliases",)) -> DataFrame:
    """A held-out menu file ``{"tools": [...]}``, one row per tool, without its aliases."""
    schema = f"tools ARRAY<STRUCT<name: STRING, description: STRING, arguments: MAP<STRING, STRING>, _http: STRING, aliases: ARRAY<STRING>>>"
    return strip_menu(spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("tools")), drop)


def strip_menu(tools: DataFrame, drop: Sequence[str] = ("aliases",)) -> DataFrame:
    return tools.drop(*drop)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A case file ``{"jobs": [...]}``; the position in the file is the case id."""
    schema = "jobs ARRAY<STRUCT<lang: STRING, question: STRING, expect: STRING>>"
    return (spark.read.schema(schema).option("multiLine", True).json(path)
            .select(F.posexplode("jobs").alias("case_id", "job")).select("case_id", "job.*"))


def read_mixture(spark: SparkSession, path: str) -> DataFrame:
    """``{"sources": {name: {weight, path, required}}}`` as one row per source."""
    schema = "sources MAP<STRING, STRUCT<weight: INT, path: STRING, required: BOOLEAN>>"
    return (spark.read.schema(schema).option("multiLine", True).json(path)
            .select(F.explode("sources").alias("source", "x")).select("source", "x.*"))


def read_grammar(spark: SparkSession, path: str) -> DataFrame:
    """A stored grammar file as the (grp, term, n) table the weighted draws read."""
    schema = "vocab MAP<STRING, MAP<STRING, BIGINT>>, pairs MAP<STRING, BIGINT>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    terms = df.select(F.explode("vocab").alias("grp", "m")).select("grp", F.explode("m").alias("term", "n"))
    pairs = df.select(F.lit("pair").alias("grp"), F.explode("pairs").alias("term", "n"))
    return terms.unionByName(pairs)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A byte-level tokenizer file (JSON) as the token table that ``merges.encode_merges`` reads.

    The file is one document of a few megabytes, read through Spark from wherever it lies. Added tokens are markers.
    """
    spec = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    letters = _byte_letters()
    as_bytes = lambda entry: bytes(letters[c] for c in entry)
    markers = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    made = {a + b: (rank, as_bytes(a), as_bytes(b)) for rank, (a, b) in reversed(list(enumerate(pairs)))}
    rows = [(i, entry.encode(), None, None, None, True) for entry, i in markers.items()]
    rows += [(i, as_bytes(entry), *made.get(entry, (None, None, None)), False) for entry, i in spec["model"]["vocab"].items() if entry not in markers]
    return spark.createDataFrame(rows, TOKENS)
