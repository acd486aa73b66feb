"""Encoding a corpus with a byte-level BPE vocabulary through its tokenization automaton.

The automaton's states are tokens; an arc from x to y means that y may follow x in a correct
tokenization. It is defined by one gadget per merge, applied in rank order to the automaton with one
state and 256 looping arcs. The gadget of merge (u, v) -> w, at rank k,

* gives w every incoming arc that u has at that time and every outgoing arc that v has, and
* takes away the arc u -> v.

So whether an arc exists after all gadgets is found by unwinding the gadgets backwards, later-born
side first, until the arc is removed or both ends are bytes. Fifty thousand states with nearly full
rows would be billions of arcs, so rows are filled on demand: an arc is unwound once per process
and then read from the table. Every prefix of a word has exactly one path, so a word is encoded in
one left-to-right run over the trie of token bytes, and its ids are the labels of that path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the published pattern that splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words and arcs remembered per process; only speed depends on it.
MEMO_WORDS = 400_000
MEMO_ARCS = 4_000_000


def default_path() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, inverted."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The tokenization automaton of a vocabulary file's content."""

    def __init__(self, content: bytes):
        model = json.loads(content)["model"]
        at = _byte_of_char()
        spelled = lambda s: bytes(at[c] for c in s)
        self.bytes_of = {i: spelled(s) for s, i in model["vocab"].items() if all(c in at for c in s)}
        by_bytes = {b: i for i, b in self.bytes_of.items()}
        self.born = dict.fromkeys(self.bytes_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for k, m in enumerate(model["merges"]):
            left, right = (spelled(x) for x in (m.split(" ") if isinstance(m, str) else m))
            u, v, w = by_bytes[left], by_bytes[right], by_bytes[left + right]
            self.removed[u, v] = k
            if w not in self.parts:
                self.parts[w], self.born[w] = (u, v), k
        # The trie of token bytes: key node * 256 + byte.
        self.step: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for i, spelling in self.bytes_of.items():
            if i not in self.parts and len(spelling) > 1:
                continue
            node = 0
            for b in spelling:
                key = node * 256 + b
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.arcs: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.pattern = regex.compile(SPLIT)

    def arc(self, x: int, y: int) -> bool:
        """Whether y may follow x, by unwinding the gadgets."""
        born, parts, before = self.born, self.parts, 1 << 60
        while True:
            if self.removed.get((x, y), before) < before:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if by >= bx:  # y took u's incoming arcs after u -> v was gone
                before, y = by + 1, parts[y][0]
            else:  # x took v's outgoing arcs as they were before
                before, x = bx, parts[x][1]

    def word(self, spelling: bytes) -> list[int]:
        """Labels of the only path over a word's bytes."""
        n = len(spelling)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        step, token_at, arcs = self.step, self.token_at, self.arcs
        for i in range(n):
            x = last[i]
            if i and x < 0:
                continue
            node, j = 0, i
            while j < n:
                node = step.get(node * 256 + spelling[j], 0)
                if not node:
                    break
                j += 1
                y = token_at[node]
                if y < 0 or last[j] >= 0:
                    continue
                if i:
                    key = x << 20 | y
                    ok = arcs.get(key)
                    if ok is None:
                        if len(arcs) >= MEMO_ARCS:
                            arcs.clear()
                        ok = arcs[key] = self.arc(x, y)
                    if not ok:
                        continue
                last[j], start[j] = y, i
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return []
        memo, out = self.memo, []
        for w in self.pattern.findall(text):
            ids = memo.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[w] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", "replace")


def vocabulary(path: str | None) -> bytes:
    with open(path or default_path(), "rb") as f:
        return f.read()


def automaton(path: str) -> Automaton:
    return _compiled(vocabulary(path))


@lru_cache(maxsize=2)
def _compiled(content: bytes) -> Automaton:
    return Automaton(content)


def _shipped(df: DataFrame, path: str | None):
    """The vocabulary, read on the driver and sent to the executors, which need no copy of the file; a few megabytes."""
    return df.sparkSession.sparkContext.broadcast(vocabulary(path))


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """``id_col, ids array<int>``: the token ids of every text, without special tokens.

    Null and empty texts have an empty list. Repeated ids and repeated texts are encoded row by row;
    other columns are not read. No shuffle: one pass over two columns.
    """
    content = _shipped(df, path)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _compiled(content.value)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                flat += a.encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.asarray(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str, path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens long`` of every row; 0 for null and empty texts."""
    content = _shipped(df, path)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _compiled(content.value)
        for batch in batches:
            n = pa.array([len(a.encode(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    return df.select(*keep, df[text_col].alias("__text")).mapInArrow(run, f"{schema}, n_tokens long")


def decode(df: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col, text``: the bytes of the arc labels, put together; a null list gives null, an empty one an empty text."""
    content = _shipped(df, path)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _compiled(content.value)
        for batch in batches:
            texts = [None if ids is None else a.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")
