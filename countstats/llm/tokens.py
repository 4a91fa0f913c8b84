"""Token counts by trie-shared dynamic programming over a public vocabulary."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"
#: A worker's trie is emptied when it has so many nodes; counts are then worked out anew.
MAX_NODES = 1_000_000
#: Only so many first characters of a pre-token are put into the trie. The rest is scored the same way
#: without nodes, holding the scores of about _HELD prefixes at a time.
DEPTH = 256
_HELD = 8192
_CODE = 0x110000  # more than any code point
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their log probability; ``unknown`` is the score of a character that no piece covers."""

    scores: dict[str, float]
    unknown: float
    longest: int

    def lengths_by_end(self) -> dict[str, list[int]]:
        """Of each last character or two of a piece: the lengths of the pieces that end so."""
        found: dict[str, set[int]] = {}
        for piece in self.scores:
            found.setdefault(piece[-2:], set()).add(len(piece))
        return {end: sorted(lengths, reverse=True) for end, lengths in found.items()}


def load_vocabulary(path: str = TOKENIZER) -> Vocabulary:
    """The pieces of a sentencepiece model file, read on the driver.

    The file orders its pieces by merge rank, which follows their frequency; with no frequencies in
    it, the unigram probability of rank r is taken as proportional to 1 / (r + 1). A character
    outside the vocabulary falls back to its UTF-8 bytes and scores 10 less than the rarest piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    scores = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
    return Vocabulary(scores, min(scores.values(), default=0.0) - 10.0, max(map(len, scores), default=1))


class TokenTrie(dict):
    """Pre-token -> number of tokens of its best segmentation, with a trie of all prefixes seen.

    A node keeps the forward score of its prefix, the best sum of piece scores over all its
    segmentations, and that segmentation's number of tokens. It is worked out once from the nodes
    above it, whichever pre-tokens share the prefix.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.lengths = vocabulary, vocabulary.lengths_by_end()
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}  # node and next character -> node
        self.score, self.count = [0.0], [0]

    def __missing__(self, word: str) -> int:
        if len(self.score) > MAX_NODES:
            self._reset()
        child, node, score, count = self.child, 0, [0.0], [0]  # scores and tokens of all prefixes of the word
        for end, letter in enumerate(word[:DEPTH], 1):
            key = node * _CODE + ord(letter)
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = len(self.score)
                best, tokens = self._extend(word, end, score, count, 0)
                self.score.append(best)
                self.count.append(tokens)
            score.append(self.score[node])
            count.append(self.count[node])
        if len(word) > DEPTH:
            return self._beyond(word, score, count)
        self[word] = count[-1]
        return count[-1]

    def _beyond(self, word: str, score: list[float], count: list[int]) -> int:
        """Tokens of a word longer than the trie is deep; a piece reaches back ``longest`` characters only."""
        first = 0
        for end in range(DEPTH + 1, len(word) + 1):
            best, tokens = self._extend(word, end, score, count, first)
            score.append(best)
            count.append(tokens)
            if len(score) > _HELD:
                gone = len(score) - self.vocabulary.longest
                del score[:gone], count[:gone]
                first += gone
        return count[-1]

    def _extend(self, word: str, end: int, score: list[float], count: list[int], first: int) -> tuple[float, int]:
        """The forward score of ``word[:end]`` and its tokens, from those of shorter prefixes: ``score[i]``
        is that of the prefix of ``first + i`` characters."""
        scores, above = self.vocabulary.scores, end - 1 - first
        letter, two = word[end - 1], word[max(0, end - 2) : end]
        best, start = score[above] + self.vocabulary.unknown, -1
        one = scores.get(letter)
        if one is not None:
            best, start = score[above] + one, above
        for length in self.lengths.get(two, ()):
            if length <= end:
                piece, before = scores.get(word[end - length : end]), end - length - first
                if piece is not None and score[before] + piece > best:
                    best, start = score[before] + piece, before
        if start < 0:
            return best, count[above] + len(letter.encode("utf-8", "surrogatepass"))
        return best, count[start] + 1


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with n_words and n_tokens for every row.

    Pre-tokens are the words between ASCII white space, each with the word-start mark before it;
    white space itself has no token. The whole text counts. A null or empty text has 0 of both.
    Each worker shares one trie among its documents and forgets it at a bounded size, so nothing is
    shuffled; a word of millions of characters adds DEPTH nodes at most. Existing columns n_words, n_tokens are replaced.
    """
    vocabulary = vocabulary or load_vocabulary()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_tokens")]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col("text").alias("_text"), F.struct(*[F.col(c) for c in keep]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(shared.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(0):
                n = total = 0
                for found in _WORD.finditer(text.as_py() or ""):
                    n += 1
                    total += trie[WORD_START + found[0]]
                words.append(n)
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["_row", "n_words", "n_tokens"])

    schema = T.StructType([source.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(run, schema).select("_row.*", "n_words", "n_tokens")
