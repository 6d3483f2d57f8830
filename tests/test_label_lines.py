"""Label lines, pieces and respelled numbers against Python's own patterns, over texts with odd blanks and line ends."""

import random
import re

from pyspark.sql import functions as F

from kolanut.functions.common import BLANK_CLASS, LINE_ENDS, SPACES, lines_of
from kolanut.functions.json import as_written
from kolanut.functions.lang import squeezed
from kolanut.functions.text import blocks
from kolanut.operators.packing import pieces
from kolanut.plans.base import VIDEO_PROMPT, _spark

LABELS = ("USER2", "USER", "CALL")


def of(spark, values, made):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", made(F.col("s")).alias("r"))
    return [r.r for r in sorted(rows.collect(), key=lambda r: r.i)]


def odd_texts():
    rng = random.Random(5)
    parts = [*LABELS, ":", " : ", "word", "word word", "\t", "　", "\xa0", "\n", "\n", "\r\n", "\r", "\x1c", "\x85", " ", "é", "😀", " "]
    return ["", "USER:", "USER: \n", "x\nUSER: a  \n b ", "USER:   a b 　\nCALL:", *("".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(300))]


def by_hand(text):
    found, label = {}, None
    for line in re.sub(rf"\r\n|[{LINE_ENDS}]", "\n", text).split("\n"):
        head = re.fullmatch(rf"{BLANK_CLASS}*({'|'.join(LABELS)}){BLANK_CLASS}*:{BLANK_CLASS}*(.*?){BLANK_CLASS}*", line)
        if head:
            label, line = head[1], head[2]
            found[label] = []
        if label:
            found[label].append(line)
    return {k: "\n".join(v).strip(SPACES) for k, v in found.items()}


def test_line_ends_and_blocks(spark):
    texts = odd_texts()
    assert of(spark, [*texts, None], lines_of) == [re.sub(rf"\r\n|[{LINE_ENDS}]", "\n", x) for x in [*texts, ""]]
    assert of(spark, texts, lambda c: blocks(c, LABELS)) == [by_hand(x) for x in texts]


def test_a_long_line_is_not_tried_for_its_end_at_every_letter():
    """A lazy value is what made the label lines slow."""
    import inspect

    from kolanut.functions import text
    assert "*?" not in inspect.getsource(text._labelled)


def test_pieces_runs_and_respelled_numbers(spark):
    texts = ["<reserved_5>ab12345 é<reserved_x>", "<<reserved_1>", "a1b", "", "٣٤٥٦ 😀ab"]
    old = F.lit(r"(<reserved_[0-9]>|\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}])")
    assert of(spark, texts, pieces) == of(spark, texts, lambda c: F.regexp_extract_all(c, old, F.lit(1)))
    assert of(spark, [" no no no nono no ", " a ab ab ab b "], squeezed) == [" no no nono no ", " a ab ab b "]
    assert of(spark, ['{"a":1.0E-5,"b":"E","E1":2}', '{"a":"\\u001F"}', '{"E":1}'], as_written) == \
        ['{"a":1e-05,"b":"E","E1":2}', '{"a":"\\u001f"}', '{"E":1}']


def test_prompts_are_cleaned_as_translate_does(spark):
    df = spark.createDataFrame([(i, 'a"b\\c\nd' * i) for i in range(12)], "event_id bigint, utext string")
    assert "translate" not in _spark(VIDEO_PROMPT)
    assert df.filter(f"NOT ({_spark(VIDEO_PROMPT)}) <=> ({VIDEO_PROMPT})").count() == 0
