"""Token counts by byte-pair merging with a heap and a linked list.

A text is split into symbols (characters). Again and again the adjacent pair whose joined piece has the lowest rank
(the leftmost such pair) is merged, until no joined pair is a piece. Each merge makes one symbol fewer, so the
count is the number of initial symbols minus the number of merges; identifiers are never looked up. A character that
is no piece counts one symbol per UTF-8 byte and never merges.

No piece goes from a word into the blank before the next one, so merging runs per word (a run of blanks and the
word after it), and the counts of words seen lately are kept in a bounded memo.
"""
from __future__ import annotations

import re
from functools import cache
from heapq import heapify, heappop, heappush
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows

BLANK = "▁"
MEMO_WORDS = 400_000
#: Longer words are counted but not kept, so that the memo's bytes are bounded as well.
MEMO_CHARS = 64
LIMIT = 4096


class MergeCounter:
    """Counts tokens for a table of piece ranks (lower merges first)."""

    def __init__(self, ranks: dict[str, float]):
        self.ranks = ranks
        self.single = {p for p in ranks if len(p) == 1}
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.by_word = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in ranks)

    def merge(self, text: str) -> int:
        """Symbols left after all merges of one word."""
        get, push, pop = self.ranks.get, heappush, heappop
        piece = list(text)
        n = count = len(piece)
        if not self.single.issuperset(piece):
            count = sum(1 if c in self.single else len(c.encode()) for c in piece)
        # an entry holds the rank, the left symbol's place and the length that the joined piece would have
        heap = [(r, i, 2) for i, r in enumerate(map(get, map(add, piece, piece[1:]))) if r is not None]
        if not heap:
            return count
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            _, i, length = pop(heap)
            j = after[i]
            left = piece[i]
            # stale if one of the two symbols has been merged since
            if not left or j >= n or len(left) + len(piece[j]) != length:
                continue
            piece[i] = left = left + piece[j]
            piece[j] = ""
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                right = left + piece[k]
                if (r := get(right)) is not None:
                    push(heap, (r, i, len(right)))
            if (h := before[i]) >= 0:
                right = piece[h] + left
                if (r := get(right)) is not None:
                    push(heap, (r, h, len(right)))
        return count

    def word(self, text: str) -> int:
        """Tokens of a blank and the word after it.

        The memo has two halves: when the newer one is full it becomes the older one, so frequent words stay.
        """
        n = self.memo.get(text)
        if n is None:
            n = self.old.get(text)
            if n is None:
                n = self.merge(BLANK + text)
            if len(text) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.old, self.memo = self.memo, {}
                self.memo[text] = n
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        marked = BLANK + text.replace(" ", BLANK)
        if not self.by_word:
            return self.merge(marked)
        if BLANK * 2 in marked:
            return sum(self.word(w[1:]) for w in re.findall(f"{BLANK}+[^{BLANK}]*", marked))
        words = marked.split(BLANK)[1:]
        known = list(map(self.memo.get, words))
        return sum(n if n is not None else self.word(w) for n, w in zip(known, words)) if None in known else sum(known)


@cache
def piece_counter(path: str) -> MergeCounter:
    """The counter for a sentence-piece model: its normal pieces, ranked by descending score."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return MergeCounter({model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size())
                         if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    ``model`` is a file of the installed tokenizers or a path to one that every executor has. Null and empty texts
    count 0; a repeated row gives a repeated result; an empty table gives none; other columns are not read.
    """
    def start():
        counter = piece_counter(model if "/" in model else model_path(model))

        def row(doc_id, text):
            n = counter(text)
            return doc_id, len(text.encode()) if text else 0, n, n > limit
        return row

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", start)
