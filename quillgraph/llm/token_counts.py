"""Token counts under a unigram model, computed once for each shared prefix of the words seen.

Distinct pre-tokens (words with their leading word mark) are inserted in a trie. A node holds the best log-probability
of any segmentation of its prefix and the number of pieces of that segmentation; both follow from the
node's ancestors, so words with a common beginning share that work. The count at a word's terminal node is its token count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A worker's trie and word table start anew beyond so many entries.
MAX_NODES = 700_000
MAX_WORDS = 400_000


def zipf_scores(model_file: str) -> dict[str, float]:
    """Log-probability of each piece of a vocabulary file.

    A unigram file states its own. A merge file only ranks its pieces; there, probabilities are taken to fall as
    one over the rank (Zipf's law).
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    scores = {model.id_to_piece(k): model.get_score(k) for k in ids}
    if len(set(scores.values())) == len(scores) and all(float(s).is_integer() for s in scores.values()):
        norm = math.log(sum(1 / (r + 1) for r in range(len(scores))))
        scores = {p: -math.log(r + 1) - norm for r, p in enumerate(sorted(scores, key=lambda p: (-scores[p], p)))}
    return scores


class PrefixTrie:
    """Terminal token counts of words, by a forward pass along the trie.

    A character that no piece covers falls back to its UTF-8 bytes, each one token of the lowest probability less ten.
    Of equally probable segmentations the one with the longer last piece is taken, at every prefix.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str] | int, int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]

    def __len__(self) -> int:
        return len(self.best)

    def tokens(self, word: str) -> int:
        """Insert ``word`` and return the count at its terminal node."""
        child, best, count, scores = self.child, self.best, self.count, self.scores
        path, node, n = [0], 0, len(word)
        for end in range(1, n + 1):
            key = node << 21 | ord(word[end - 1])
            found = child.get(key)
            if found is None:
                low = max(0, end - self.longest)
                raw = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top, pieces = -math.inf, 0
                for begin in range(low, end):
                    score = scores.get(word[begin:end])
                    if score is not None and best[path[begin]] + score > top:
                        top, pieces = best[path[begin]] + score, count[path[begin]] + 1
                if best[path[end - 1]] + raw * self.byte > top:
                    top, pieces = best[path[end - 1]] + raw * self.byte, count[path[end - 1]] + raw
                found = child[key] = len(best)
                best.append(top)
                count.append(pieces)
            path.append(found)
            node = found
        return count[node]


class _Counts(dict):
    """Token count of each word seen."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.trie = PrefixTrie(scores)

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        if len(self.trie) > MAX_NODES:
            self.trie.clear()
        value = self[word] = self.trie.tokens(MARK + word)
        return value


_tables: dict[str, _Counts] = {}


def count_tokens(df: DataFrame, id_col: str, text_col: str, model_file: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row, over its whole text.

    Words are what Unicode white space separates. One pass without a shuffle: each worker's trie is bounded
    and forgets when it is full, which changes its speed and not its counts. Null and empty texts have no words and no
    tokens; null and repeated ids are kept as they are; other columns are left out, so their names cannot
    clash. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _tables.get(model_file) or _tables.setdefault(model_file, _Counts(zipf_scores(model_file)))
        for batch in batches:
            words, tokens = [], []
            for value in batch.column(1):
                found = (value.as_py() or "").split()
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
