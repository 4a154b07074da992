"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links: where no child matches, the link leads to the state that
has the greedy pieces of the consumed text popped off, and each link carries how many pieces that were.
One pass over a word then counts its greedy longest-match pieces; no piece is ever built.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._util import bound_batches

#: Word counts remembered by a worker; forgotten as a whole when full.
REMEMBERED = 200_000
_UNKNOWN = 1 << 40
#: Stands for the space before a word in a sentencepiece model.
MARK = "▁"


class LongestMatch:
    """Counts greedy longest-match pieces: `first` starts a word, `rest` continues one.

    An empty piece in `first` is the bare word mark: a word that starts with no longer piece starts with it,
    and a mark inside a word is matched like that before one. `byte_pieces` are the bytes that have a piece;
    a character that no piece matches is as many pieces as it has bytes. A word that greedy matching cannot
    finish even so is one unknown piece, as in word-piece tokenizers.
    """

    def __init__(self, first: set[str], rest: set[str], byte_pieces: frozenset[int] = frozenset()):
        self.byte_pieces = byte_pieces
        self.child: list[dict[str, int]] = [{}, {}]
        final = [0, 0]  # the number of pieces that end here as one
        spelt = {c for piece in first | rest for c in piece} - rest - {MARK} if byte_pieces else set()
        for root, pieces in ((0, first), (1, rest), (1, {c for c in spelt if self._bytes(c)})):
            for piece in pieces:
                if not piece:
                    continue
                u = root
                for c in piece:
                    v = self.child[u].get(c)
                    if v is None:
                        v = self.child[u][c] = len(self.child)
                        self.child.append({})
                        final.append(0)
                    u = v
                final[u] = 1 if piece not in spelt or root == 0 else self._bytes(piece)
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        if "" in first:
            self.fail[0], self.pops[0] = 1, 1
            self.child[1].setdefault(MARK, 0)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.child[u].items():
                if not v:
                    continue
                if final[v]:
                    self.fail[v], self.pops[v] = 1, final[v]
                else:
                    w, popped = self.fail[u], self.pops[u]
                    while w >= 0 and c not in self.child[w]:
                        popped += self.pops[w]
                        w = self.fail[w]
                    if w >= 0:
                        self.fail[v], self.pops[v] = self.child[w][c], popped
                queue.append(v)

    def _bytes(self, c: str) -> int:
        """How many byte pieces spell a character; 0 if there are none for it."""
        spelling = c.encode()
        return len(spelling) if self.byte_pieces.issuperset(spelling) else 0

    def count(self, word: str) -> int:
        """The number of pieces, or -1 if greedy matching gets stuck. The empty word has none."""
        child, fail, pops = self.child, self.fail, self.pops
        u = n = 0
        if not word:
            return 0
        for c in word:
            v = child[u].get(c)
            while v is None:
                if u == 1:
                    size = self._bytes(c)
                    if not size:
                        return -1
                    n, v = n + size, 1
                    break
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return -1
                v = child[u].get(c)
            u = v
        while u != 1:
            n += pops[u]
            u = fail[u]
            if u < 0:
                return -1
        return n


def piece_vocabulary(path: str) -> tuple[set[str], set[str], frozenset[int]]:
    """First and continuing pieces of a sentencepiece model, those with and without its word mark (the bare mark
    is the empty first piece), and the bytes that have pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    pieces = [model.id_to_piece(i) for i in ids if not model.is_byte(i)]
    spelt = frozenset(int(model.id_to_piece(i)[1:-1], 16) for i in ids if model.is_byte(i))
    return {p[1:] for p in pieces if p.startswith(MARK)}, {p for p in pieces if not p.startswith(MARK)}, spelt


def token_counts(docs: DataFrame, vocabulary: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row, over the whole text.

    Words are runs outside white space (0x20, 0x09-0x0D). Null and empty texts have no words. Rows are
    independent, so null and repeated ids change nothing; other columns are ignored. A vocabulary
    has the arguments of `LongestMatch`; the automaton is bounded by the model file and is broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(LongestMatch(*vocabulary))

    class Remembered(dict):
        def __missing__(self, word):
            if len(self) >= REMEMBERED:
                self.clear()
            n = shared.value.count(word.decode())
            n = n if n >= 0 else 1 + _UNKNOWN
            if len(word) <= 64:
                self[word] = n
            return n

    def run(batches):
        known = Remembered().__getitem__
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                words = (batch.column(1)[i].as_py() or "").encode().split()
                total = sum(map(known, words))
                rows.append((len(words), total % _UNKNOWN, total // _UNKNOWN))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
