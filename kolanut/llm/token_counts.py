"""Token counts by a compiled finite-state transducer.

A merge tokenizer splits every prefix of a text in exactly one way, and the last token of that split is
the one that may stand behind the split before it. The transducer's state therefore holds the longest
piece prefix that the text read so far ends in, and the last token at each place within it; a step reads
one letter, and its emission is the change in the number of tokens. States are made when first met
and kept in a bounded table.

No piece holds a space mark behind another letter, so the state behind such a place is the start state
whatever came before. The state map of a chunk (entry state to exit state and emitted tokens) is thus
constant behind the first such place, and is held as ``head`` (letters still to be read from the entry
state), ``tokens`` (emitted between the first and the last such place) and ``tail`` (letters read since, which
name the exit state). Such maps compose associatively, so a text's chunks are folded pairwise as in
a parallel prefix scan, wherever the chunks were read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = 1 << 16
MAX_STATES = 200_000
MAX_TRIED = 12
CLOSED = ""
MAX_WORDS = 300_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Where no piece mixes letters with other signs, words are also cut between the two.
_RUNS = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*(?:[\d_]|[^\w{MARK}])+|{MARK}+")


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The split of a short text by its definition: merge the best adjacent pair until none is left."""
    parts = list(text)
    while len(parts) > 1:
        best = max(range(len(parts) - 1), key=lambda i: (scores.get(parts[i] + parts[i + 1], float("-inf")), -i))
        if parts[best] + parts[best + 1] not in scores:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts


def last_merges(scores: dict[str, float]) -> dict[str, tuple[str, str]]:
    """For each piece of several letters that merging can reach, the two pieces it is put together from last."""
    out = {}
    for piece in scores:
        without = {k: v for k in {piece[i:j] for i in range(len(piece)) for j in range(i + 2, len(piece) + 1)} - {piece}
                   if (v := scores.get(k)) is not None}
        parts = merged(piece, without)
        if len(parts) == 2 and merged(piece, scores) == [piece]:
            out[piece] = parts[0], parts[1]
    return out


class Transducer:
    """Emitted-token counts over letters, from the scores of the pieces (higher merges first, ties leftmost)."""

    def __init__(self, scores: dict[str, float], made_of: dict[str, tuple[str, str]]):
        self.pieces = frozenset(p for p in scores if len(p) == 1 or p in made_of)
        self.rank = {p: -scores[p] for p in scores}
        self.made_of = made_of
        self.under: dict[str, list[str]] = {}
        for p in self.pieces:
            for k in range(1, len(p)):
                self.under.setdefault(p[:k], []).append(p)
        self.follows: dict[tuple[str, str], bool] = {}
        self.kept: dict[tuple[str | None, str], str | None] = {}
        self.alike: dict[tuple, str] = {}
        self._clear()

    def _clear(self) -> None:
        self.names = [("", (None,), (0,))]
        self.ids = {self.names[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def may_follow(self, a: str | None, b: str) -> bool:
        """Whether token ``b`` can stand right behind token ``a``: undoing their merges from the last back,
        no merge across the border comes before the merges that make them."""
        if a is None:
            return True
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > 2 * MAX_STATES:
                self.follows.clear()
            known = self.follows[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        rank, made_of = self.rank, self.made_of
        before, ties = float("inf"), False
        while True:
            across = rank.get(a + b)
            if across is not None and (across < before or ties and across == before):
                return False
            left, right = made_of.get(a), made_of.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and rank[a] > rank[b]:
                before, ties, a = rank[a], False, left[1]
            else:
                before, ties, b = rank[b], True, right[0]

    def _held(self, last: str | None, begun: str) -> str | None:
        """What the state keeps of the token ``last`` before a token that begins with ``begun``: None where any
        may follow, CLOSED where none can, else the first met of the tokens that let the same ones follow."""
        if not begun:
            return last
        known = self.kept.get((last, begun), begun)
        if known is begun:
            if len(self.kept) > 4 * MAX_STATES:
                self.kept.clear()
            longer = self.under.get(begun)
            if longer is None:
                known = CLOSED
            elif last is None or len(longer) > MAX_TRIED:
                known = last
            else:
                known = self.alike.setdefault((begun, tuple([self.may_follow(last, p) for p in longer])), last)
                if not self.may_follow(known, longer[0]) and not any(self.may_follow(known, p) for p in longer):
                    known = CLOSED
            self.kept[last, begun] = known
        return known

    def _step(self, state: int, letter: str) -> tuple[int, int]:
        seen, last, behind = self.names[state]
        grown = seen + letter
        size = len(grown)
        token = emitted = None
        for place in range(size):
            piece = grown[place:]
            if (place == size - 1 or piece in self.pieces) and last[place] != CLOSED and self.may_follow(last[place], piece):
                token = piece
                emitted = behind[place] + (1 if piece in self.pieces else len(piece.encode()))
                break
        # only places from which a token can still go on are kept in the state
        places, counts, start = [*last, token], [*behind, emitted], size
        for place in range(size - 1, -1, -1):
            if places[place] != CLOSED:
                places[place] = self._held(places[place], grown[place:])
            if places[place] == CLOSED:
                counts[place] = emitted
            else:
                start = place
        name = (grown[start:], tuple(places[start:]), tuple([c - emitted for c in counts[start:]]))
        known = self.ids.get(name)
        if known is None:
            known = self.ids[name] = len(self.names)
            self.names.append(name)
            self.steps.append({})
        self.steps[state][letter] = known, emitted
        return known, emitted

    def count(self, word: str) -> int:
        """Tokens emitted over a word read from the start state."""
        if len(self.names) > MAX_STATES:
            self._clear()
        state = total = 0
        steps = self.steps
        for letter in word:
            state, emitted = steps[state].get(letter) or self._step(state, letter)
            total += emitted
        return total


class Counter:
    """Chunk maps and their composition; remembers the counts of the words met, up to a bound."""

    def __init__(self, scores: dict[str, float], made_of: dict[str, tuple[str, str]] | None = None):
        self.transducer = Transducer(scores, last_merges(scores) if made_of is None else made_of)
        self.known: dict[str, int] = {}
        self.words = _RUNS if all(len(_RUNS.findall(p)) == 1 for p in scores) else _WORDS

    def count(self, marked: str) -> int:
        total, known = 0, self.known
        for word in self.words.findall(marked):
            n = known.get(word)
            if n is None:
                if len(known) >= MAX_WORDS:
                    known.clear()
                n = self.transducer.count(word)
                if len(word) <= 64:
                    known[word] = n
            total += n
        return total

    def chunk_map(self, marked: str) -> tuple[str, int | None, str]:
        """(head, tokens, tail); tokens is None where no word ends in the chunk, and all of it is head."""
        first = _WORDS.match(marked)
        if first is None or first.end() == len(marked):
            return marked, None, ""
        cut = marked.rfind(MARK)
        while marked[cut - 1] == MARK:
            cut -= 1
        if cut < first.end():  # only the leading run of marks was found
            cut = first.end()
        return marked[:first.end()], self.count(marked[first.end():cut]), marked[cut:]

    def compose(self, a, b):
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def fold(self, maps: list) -> int:
        """The count of a whole text from the maps of its chunks, composed pairwise."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        head, tokens, tail = maps[0]
        return self.count(head) + (0 if tokens is None else tokens + self.count(tail))


def marked_text(text: str) -> str:
    """The letters that the pieces are made of: a mark for each space and one before the text."""
    return MARK + text.replace(" ", MARK) if text else ""


def _counted(batches: Iterator[pa.RecordBatch], compiled: tuple, chunk: int) -> Iterator[pa.RecordBatch]:
    counter = Counter(*compiled)
    for batch in batches:
        counts = []
        for text in batch.column("_text"):
            marked = marked_text(text.as_py() or "")
            counts.append(counter.fold([counter.chunk_map(marked[i:i + chunk]) for i in range(0, len(marked), chunk)]))
        kept = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], [*kept, "n_tokens"])


def read_scores(path: str) -> dict[str, float]:
    """The mergeable pieces of a sentencepiece BPE model with their scores; refuses one with another normaliser."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if any(MARK in p.lstrip(MARK) for p in scores) or sp.encode("  a", out_type=str)[0] != MARK * 2:
        raise ValueError("the model does not start words at a space mark")
    return scores


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_tokens``.

    The count is that of sentencepiece on the whole text, without begin or end tokens. Null and empty
    texts count 0. Repeated rows are counted each; an ``n_tokens`` column that is there already is replaced.
    The model's pieces (32,000) travel with the function; nothing is shuffled. A text of any
    length is read in chunks; very long words are not kept in the word table.
    """
    scores = read_scores(model_path)
    compiled = scores, last_merges(scores)
    kept = docs.drop("n_tokens").withColumnRenamed(text, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")
    return kept.mapInArrow(lambda batches: _counted(batches, compiled, chunk), f"{schema}{', ' if schema else ''}n_tokens bigint")


def n_bytes(text: str | Column = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
