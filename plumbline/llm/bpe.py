"""Byte-level BPE by a trie over distinct words: shared prefixes are encoded once.

Every prefix of a word has one valid encoding, and that of prefix[:i] is the encoding of prefix[:i-len(t)] followed by
one token t that ends at i. So a trie node (a prefix) needs to keep only its last token: t is the token for which the
last token of the shorter prefix and t stay apart under the merges. A depth-first walk over the trie sets these states;
words read their ids by walking back from their node. The result equals merging pairs by rank.
"""
from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

FILE = "byte_bpe_50k.tiktoken"
#: Splits a text before the merges; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 400_000  # words a worker remembers; beyond it the memory starts anew
LONG = 256  # bytes; longer words aren't remembered


def vocabulary_folder() -> str:
    """PLUMBLINE_TOKENIZERS, or the folder of the installed vocabulary package, or /opt/tokenizers."""
    if at := os.environ.get("PLUMBLINE_TOKENIZERS"):
        return at
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.__file__)
    except ImportError:
        return "/opt/tokenizers"


class TrieEncoder:
    """Encodes words (bytes) by vocabulary {bytes: rank}; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        # Reversed vocabulary: suffixes of tokens, to stop looking back where no token can end.
        self.tails: set[bytes] = {k[i:] for k in ranks for i in range(len(k))}
        self.known: dict[str, list[int]] = {}

    def merged(self, word: bytes) -> list[int]:
        """Merging of the pair of least rank, first from the left, until none is left."""
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stays(self, a: int, b: int) -> bool:
        """Whether token a followed by token b is how their joined bytes are encoded."""
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            got = self.apart[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return got

    def encode(self, words: set[str]) -> dict[str, list[int]]:
        """{word: ids} of distinct words, by one trie over their bytes."""
        # A node is [children by byte, last token, its length, parent, word or None]; the root has no token.
        root: list = [{}, -1, 0, None, None]
        for w in words:
            node = root
            for x in w.encode("utf-8", "surrogatepass"):
                nxt = node[0].get(x)
                if nxt is None:
                    nxt = node[0][x] = [{}, -1, 0, node, None]
                node = nxt
            node[4] = w
        out: dict[str, list[int]] = {}
        if root[4] is not None:
            out[root[4]] = []
        path, ranks, stays, tails = bytearray(), self.ranks, self.stays, self.tails
        stack = [(root, iter(root[0].items()))]
        nodes = [root]
        while stack:
            step = next(stack[-1][1], None)
            if step is None:
                stack.pop()
                nodes.pop()
                if path:
                    path.pop()
                continue
            byte, node = step
            path.append(byte)
            nodes.append(node)
            end = len(path)
            # Tokens that end here, longest first.
            length = 1
            while length < end and bytes(path[end - length - 1 :]) in tails:
                length += 1
            while length:
                t = ranks.get(bytes(path[end - length :]))
                if t is not None:
                    before = nodes[end - length]
                    if before[1] < 0 or stays(before[1], t):
                        node[1], node[2] = t, length
                        break
                length -= 1
            if node[4] is not None:
                ids, i = [], end
                while i:
                    ids.append(nodes[i][1])
                    i -= nodes[i][2]
                out[node[4]] = ids[::-1]
            stack.append((node, iter(node[0].items())))
        return out

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        """ids of each text; an empty and a null text give an empty list."""
        split = [_split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = {w for s in split for w in s if w not in known}
        got = self.encode(new) if new else {}
        known.update((w, i) for w, i in got.items() if len(w) <= LONG)
        out = []
        for s in split:
            ids: list[int] = []
            for w in s:
                ids += known[w] if w in known else got[w]
            out.append(ids)
        return out


_split = regex.compile(PATTERN).findall


@lru_cache(1)
def encoder(path: str) -> TrieEncoder:
    """The encoder of a rank file (base64 token and rank in each line); one per worker."""
    with open(path, "rb") as f:
        return TrieEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encoded(df: DataFrame, key: str, text: str, path: str | None = None, sizes: bool = False) -> DataFrame:
    """(key, ids array<int>) of each row, or with `sizes` (key, size int); rows stay where they are, nothing is shuffled."""
    path = path or os.path.join(vocabulary_folder(), FILE)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                ids = enc.encode_texts(part.column("_text").to_pylist())
                out = pa.array([len(i) for i in ids], pa.int32()) if sizes else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("_key"), out], [key, "size" if sizes else "ids"])

    return df.selectExpr(f"`{key}` as _key", f"`{text}` as _text").mapInArrow(run, f"`{key}` {kind.simpleString()}, " + ("size int" if sizes else "ids array<int>"))
