"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's pieces form a byte trie. A failure link of node *v* leads to the
node of what remains of *v*'s string after its longest-match pieces are popped
from the front, with the number of popped pieces beside it. Reading a
word byte by byte follows trie edges or failure links, so the number of greedy pieces
comes out in time linear in the word, without ever building a piece.

Words are runs of ASCII letters, digits and non-ASCII bytes, or else single other
bytes that aren't white space. A word is matched with a leading space, the form in
which the vocabulary holds pieces that begin a word; all single bytes are pieces, so every
word has a length. A null or empty text has no words and no tokens. Texts are judged alone and whole, however long:
repeated rows get equal results; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame

from .common import id_text, map_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO_WORDS = 300_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0D]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_pieces(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links and popped-piece counts, over all pieces of a vocabulary."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}]
        text: list[bytes] = [b""]
        final = [False]
        for piece in sorted(set(pieces)):
            v = 0
            for i, c in enumerate(piece):
                w = self.next[v].get(c)
                if w is None:
                    w = self.next[v][c] = len(self.next)
                    self.next.append({})
                    text.append(piece[: i + 1])
                    final.append(False)
                v = w
            final[v] = True
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        # Breadth first: a node's link is found from its parent's, which is known by then.
        queue = [0]
        for v in queue:
            for c, w in self.next[v].items():
                queue.append(w)
                if final[w]:
                    self.fail[w], self.popped[w] = 0, 1
                    continue
                z, count = self.fail[v], self.popped[v]
                while z != -1 and c not in self.next[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z != -1:
                    self.fail[w], self.popped[w] = self.next[z][c], count
        if any(bytes([b]) not in set(pieces) for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match segmentation."""
        nxt, fail, popped = self.next, self.fail, self.popped
        v, total = 0, 0
        for c in word:
            while (w := nxt[v].get(c)) is None:
                total += popped[v]
                v = fail[v]
            v = w
        while v:
            total += popped[v]
            v = fail[v]
        return total


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text; one narrow pass, no shuffle.

    Word lengths are remembered per task (MEMO_WORDS words, then afresh): words repeat, texts don't matter.
    """
    path = path or default_path()
    held: dict = {}

    def rows(ids: list, bodies: list) -> dict:
        if "machine" not in held:
            held["machine"], held["memo"] = Automaton(load_pieces(path)), {}
        machine, memo = held["machine"], held["memo"]
        n_words, n_tokens = [], []
        for body in bodies:
            found = _WORD.findall(body)
            for w in set(found).difference(memo):
                memo[w] = machine.count(b" " + w)
            n_words.append(len(found))
            n_tokens.append(sum(map(memo.__getitem__, found)))
            if len(memo) > MEMO_WORDS:
                memo.clear()
        return {"doc_id": ids, "n_words": n_words, "n_tokens": n_tokens}

    return map_rows(id_text(docs), rows, "doc_id long, n_words long, n_tokens long")
