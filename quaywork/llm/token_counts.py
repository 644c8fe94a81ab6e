"""Counting unigram-model tokens without making them.

A text's best segmentation under a unigram vocabulary is found by dynamic programming over its characters; only the best
score and its number of pieces are carried along. The pieces that end at each character come from an Aho-Corasick
automaton, longest first, which is the order in which the exact tokenizer meets them by start; a later one wins only if
its score is higher. A character that no piece covers alone costs ten less than the lowest score, and unknown ones in a
row count once.

No piece goes on with a space mark after another character, so a text falls into independent words (a run of marks and
what follows); with whole-number scores the sums are exact and each distinct word of a batch is solved once.

Style: one map over Arrow batches; the automaton is built once in each worker, and memory is bounded by a slice of text
and a word memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import pick
from ._text import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 500_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def model_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def marked(text: str) -> str:
    """The text as the vocabulary sees it: a mark before it and for each space; an empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece goes on with a space mark, so words aren't independent")
        self.memo: dict[str, tuple[int, int, float]] = {}

    def count(self, word: str) -> tuple[int, int, float]:
        """Pieces, unknown pieces and score of the best segmentation."""
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
        for last, found in self.automaton.iter(word):
            ends[last + 1].append(found)
        best, count, unknowns, open_unknown = [0.0], [0], [0], [False]
        for end in range(1, len(word) + 1):
            top = None
            single = False
            for size, score in ends[end]:
                single = single or size == 1
                total = best[end - size] + score
                if top is None or total > top:
                    top, start, unknown = total, end - size, False
            if not single:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, start, unknown = total, end - 1, True
            more = not (unknown and open_unknown[start])
            best.append(top)
            count.append(count[start] + more)
            unknowns.append(unknowns[start] + (unknown and more))
            open_unknown.append(unknown)
        return count[-1], unknowns[-1], best[-1]

    def count_text(self, text: str | None) -> tuple[int, int, float]:
        memo, pieces, unknowns, score = self.memo, 0, 0, 0.0
        for word in _WORD.findall(marked(text or "")):
            known = memo.get(word)
            if known is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                known = memo[word] = self.count(word)
            pieces += known[0]
            unknowns += known[1]
            score += known[2]
        return pieces, unknowns, score


_COUNTERS: dict[int, UnigramCounter] = {}


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_unknown, score of every whole text under the unigram vocabulary ``pieces``.

    Scores must be whole numbers. A null or empty text has no tokens and score 0. Rows are independent: repeated rows,
    ties and null ids give a row each; other columns are ignored; no rows, no rows.
    """
    if any(s != int(s) for _, s in pieces):
        raise ValueError("scores must be whole numbers")
    source = pick(docs, "doc_id", "text")
    key = hash(tuple(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = UnigramCounter(pieces)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                texts = part.column("text").to_pylist()
                found = [counter.count_text(t) for t in texts]
                tokens, unknowns, scores = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknowns, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_chars", "n_tokens", "n_unknown", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long, n_unknown long, score double")
