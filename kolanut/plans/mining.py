"""The dictionary mined from documents and pages, whole texts."""

from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.text import tagged_spans
from kolanut.operators.mining import (
    grammar_counts, pair_counts, scene_sentences, sentence_count, tagged, term_counts, top_pairs,
)
from kolanut.plans.base import texts


# The documents hold no camera words, so common words of theirs stand for some.
_WORDS = (("the", "the wide shot"), ("of", "tracks"), ("and", "night and pan"), ("der", "low angle"), ("die", "CLOSE-UP close ups"),
          ("que", "Insert, zooming"), ("la", "point of p.o.v."), ("de", "forms"), ("en", "two shot: whip pan"), ("un", "bird's eye"),
          ("for", "execute"), ("is", "day"), ("ver", "moves in"), ("et", "sunset"), ("mit", "steadicam"), ("por", "hand held MS."))


def _scripted(column: str) -> str:
    """SQL for the text with those words in it, the same in both engines."""
    for word, term in _WORDS:
        column = "replace(%s, ' %s ', ' %s ')" % (column, word, term.replace("'", "''"))
    return column


def _sentences(spark, sf):
    script = F.expr(_scripted("text").replace("''", "\\'"))
    return scene_sentences(texts(spark, sf, "documents", "doc_id"), script, None)


def mine_terms(spark, sf):
    return term_counts(tagged(_sentences(spark, sf)))


def mine_terms_anchored(spark, sf):
    return term_counts(tagged(_sentences(spark, sf), anchored=True))


def mine_pairs(spark, sf):
    return pair_counts(tagged(_sentences(spark, sf)))


def mine_topk(spark, sf):
    return top_pairs(mine_pairs(spark, sf), 60)


def mine_grammar(spark, sf):
    """Both counts in one pass, over page paragraphs and documents together."""
    pages = scene_sentences(texts(spark, sf, "pages", "page_id"), F.col("html"), "p")
    return grammar_counts(tagged(_sentences(spark, sf).unionByName(pages)))


def sentence_total(spark, sf):
    return sentence_count(_sentences(spark, sf))


def tagged_span_stats(spark, sf):
    p = texts(spark, sf, "pages", "page_id").select("page_id", tagged_spans(F.col("html"), "p").alias("s"))
    return p.select("page_id", F.size("s").alias("spans"), F.md5(F.array_join("s", "|")).alias("digest"))


def page_sentences(spark, sf):
    s = scene_sentences(texts(spark, sf, "pages", "page_id"), F.col("html"), "p", ("page_id",))
    return s.groupBy("page_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"))


QUERIES = {
    "mine_terms": mine_terms, "mine_terms_anchored": mine_terms_anchored, "mine_pairs": mine_pairs, "mine_topk": mine_topk,
    "mine_grammar": mine_grammar, "sentence_count": sentence_total, "tagged_spans": tagged_span_stats,
    "page_sentences": page_sentences,
}

_EDGE_AFTER, _EDGE_BEFORE = "(?:[^\\p{L}\\p{N}_]|$)", "(?:^|[^\\p{L}\\p{N}_])"


def _rx(pattern: str, anchored: bool = False) -> str:
    """The dictionary's word edges spelt without look-around."""
    parts = []
    for alt in _alternatives(pattern):
        left, right = alt.startswith(r"\b"), alt.endswith(r"\b")
        core = alt[2:] if left else alt
        core = core[:-2] if right else core
        # an edge next to an optional dot holds by itself when the dot is there
        tail = _EDGE_AFTER if right or anchored else ""
        parts.append((_EDGE_BEFORE if left or anchored else "") + core + tail)
    return "(?i)(?:" + "|".join(parts).replace("'", "''") + ")"


def _alternatives(pattern: str) -> list[str]:
    out, depth = [""], 0
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out


_SPLIT = "string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_DOC = f"sent AS (SELECT unnest({_SPLIT.format(_scripted('text'))}) AS s FROM documents)"
# a span runs from the first opening tag before a close up to that close
_SPANS = ("list_filter(list_transform(string_split(html, '</p>'), lambda x: CASE WHEN contains(x, '<p>') "
          "THEN substr(x, strpos(x, '<p>') + 3) END), lambda x: x IS NOT NULL)")
_BOTH = (f"sent AS (SELECT unnest({_SPLIT.format(_scripted('text'))}) AS s FROM documents UNION ALL "
         f"SELECT unnest({_SPLIT.format('p')}) AS s FROM (SELECT unnest({_SPANS}) AS p FROM pages))")


def _terms(sent: str, anchored: bool = False) -> str:
    """CTEs up to ``hit`` (s, grp, term): one row per sentence and term."""
    rows = " UNION ALL ".join(
        f"SELECT i, '{g}' AS grp, '{term}' AS term FROM num WHERE regexp_matches(s, '{_rx(p, anchored)}')"
        for g, d in t.DICTIONARY.items() for p, term in d)
    return f"WITH {sent}, num AS (SELECT row_number() OVER () AS i, s FROM sent), hit AS ({rows})"


_PAIRS = ('SELECT a.term AS "left", b.term AS "right", count(*) AS n FROM hit a JOIN hit b USING (i) '
          "WHERE a.grp = 'shot' AND b.grp = 'move' GROUP BY 1, 2")
ORACLE = {
    "mine_terms_anchored": f"{_terms(_DOC, True)} SELECT grp, term, count(*) AS n FROM hit GROUP BY 1, 2",
    "mine_terms": f"{_terms(_DOC)} SELECT grp, term, count(*) AS n FROM hit GROUP BY 1, 2",
    "mine_pairs": f"{_terms(_DOC)} {_PAIRS}",
    "mine_topk": f'{_terms(_DOC)} SELECT * FROM ({_PAIRS}) ORDER BY n DESC, "left", "right" LIMIT 60',
    "mine_grammar": f"""{_terms(_BOTH)} SELECT grp, term, count(*) AS n FROM hit GROUP BY 1, 2 UNION ALL
        SELECT 'pair' AS grp, "left" || '|' || "right" AS term, n FROM ({_PAIRS})""",
    "sentence_count": f"WITH {_DOC} SELECT count(*) AS sentences FROM sent",
    "tagged_spans": f"SELECT page_id, CAST(len({_SPANS}) AS INTEGER) AS spans, md5(array_to_string({_SPANS}, '|')) AS digest FROM pages",
    "page_sentences": f"""SELECT page_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM
        (SELECT page_id, unnest({_SPLIT.format('p')}) AS s FROM (SELECT page_id, unnest({_SPANS}) AS p FROM pages)) GROUP BY 1""",
}
