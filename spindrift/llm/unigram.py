"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton reports every vocabulary piece that ends at each character, longest first. Dynamic
programming carries, for each place, the best score and the number of pieces on the best path; no path is kept.
The tie rule is the tokenizers library's: of equal scores the piece that starts first wins, and an unknown
character (its score is the least score less 10), which comes last, only replaces what scores strictly less. Runs of unknown
characters are one token, or with byte fallback one token per UTF-8 byte.

The text is split as the library's Metaspace does: spaces become "▁", one is put in front, and each starts a
word. Pieces never cross words, so a worker counts each different word once (bounded table, emptied when full).

Defined cases: null and empty texts have 0 tokens; rows repeat as they are; long words cost their matches. Only
doc_id and text are read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SPACE = "▁"
UNKNOWN_LESS = 10.0
CACHE = 500_000


def piece_scores(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, by id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), float(m.get_score(i))) for i in range(m.get_piece_size())]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True, cache: int = CACHE):
        self.auto = ahocorasick.Automaton()
        last = dict(vocab)  # of equal pieces the last counts
        for piece, score in last.items():
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p in last if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN_LESS
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in last for b in range(256))
        self.cache, self.most = {}, cache

    def word(self, w: str) -> tuple[int, float]:
        """Pieces and score of the best path over one word."""
        n = len(w)
        low = float("-inf")
        best, count, odd = [low] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        single, unknown, by_bytes, at = self.single, self.unknown, self.bytes, 0

        def close(p: int) -> None:
            """The unknown candidate for the place after p, once all pieces that end there were tried."""
            if w[p] not in single and best[p] + unknown > best[p + 1]:
                best[p + 1] = best[p] + unknown
                count[p + 1] = count[p] + (len(w[p].encode()) if by_bytes else 0 if odd[p] else 1)
                odd[p + 1] = True

        for end, (length, score) in self.auto.iter(w):
            while at < end:
                close(at)
                at += 1
            start = end + 1 - length
            if (s := best[start] + score) > best[end + 1]:
                best[end + 1], count[end + 1], odd[end + 1] = s, count[start] + 1, False
        while at < n:
            close(at)
            at += 1
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        s = text.replace(" ", SPACE)
        words = (s[1:] if s[0] == SPACE else s).split(SPACE)
        get, n, score = self.cache.get, 0, 0.0
        for w in words:
            if (got := get(w)) is None:
                got = self.word(SPACE + w)
                if len(self.cache) >= self.most:
                    self.cache.clear()
                if len(w) <= 64:
                    self.cache[w] = got
            n += got[0]
            score += got[1]
        return n, score


_open: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _open:
        _open[path] = Counter(piece_scores(path))
    return _open[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score (of the best paths, summed by word)."""
    small_batches(docs.sparkSession)

    def run(batches):
        if path:
            c = counter(path)
        else:
            import public_tokenizers

            c = counter(public_tokenizers.path("piece_bpe_32k.model"))
        for b in batches:
            got = [c.text(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], "int64"), pa.array([s for _, s in got], "float64")], ["doc_id", "n_tokens", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, score double")


def query(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
