"""Token counts by a two-tier lookup, all of it before any shuffle.

Tier 1 is a compact table of how many tokens frequent pre-tokens have, broadcast to all tasks (``TABLE`` entries at most). Tier 2
is a cache in each worker, of ``CACHE`` entries at most: a pre-token that the table lacks is encoded once by the tokenizer itself and
kept. Pre-tokens are never shuffled. The table is a warm start and nothing more: it is counted on a bounded sample of texts
(``SAMPLE_ROWS``), and every count is what the tokenizer gives, whatever the table holds.

The text is cut at the tokenizer's added tokens (their strings count as one token, as the library has it by default), and then by the
pattern of byte-level BPE. A pre-token's length does not depend on its neighbours.

Defined results: a null or empty text has 0 bytes and 0 tokens. Equal rows count alike; extra columns are left out.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.functions.ship import ship

TABLE, CACHE, SAMPLE_ROWS = 32_768, 400_000, 2_000
#: Pre-tokens longer than this are encoded and not kept.
KEEP_CHARS = 64
# The public pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Lengths(dict):
    """Pre-token to number of tokens; a miss is encoded and, while there is room, kept."""

    def __init__(self, tokenizer, known: dict[str, int]) -> None:
        super().__init__(known)
        self.tokenizer, self.room = tokenizer, len(known) + CACHE

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= KEEP_CHARS:
            if len(self) >= self.room:
                for old in [k for k, _ in zip(self, range(CACHE // 4), strict=False)]:
                    del self[old]
            self[piece] = n
        return n


class Counting:
    """Counts tokens of texts; made once in each worker."""

    def __init__(self, model: str, known: dict[str, int]) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        added = sorted((t["content"] for t in json.loads(model)["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cut = regex.compile(PATTERN).findall
        self.lengths = Lengths(tokenizer, known)

    def pieces(self, text: str) -> list[str]:
        return self.cut(text)

    def count(self, text: str) -> int:
        look = self.lengths.__getitem__
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(look, self.cut(p))) for p in parts)
        return sum(map(look, self.cut(text)))


def vocabulary(name: str) -> str:
    """The file of a byte-level BPE tokenizer in the format of the tokenizers library."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def frequent(docs: DataFrame, model: str, sample_rows: int = SAMPLE_ROWS, size: int = TABLE) -> dict[str, int]:
    """The most frequent pre-tokens of about ``sample_rows`` texts, and their numbers of tokens."""
    rows = docs.count()
    if not rows:
        return {}
    every = max(1, rows // sample_rows)
    texts = docs.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(every)) == 0).select(F.substring("text", 1, 4000).alias("text")).limit(4 * sample_rows)
    counting, seen = Counting(model, {}), Counter()
    for (text,) in texts.toLocalIterator():
        seen.update(counting.pieces(text or ""))
    return {p: counting.lengths[p] for p, _ in seen.most_common(size) if len(p) <= KEEP_CHARS}


def count_tokens(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)
    model = vocabulary(vocabulary_name)
    context = docs.sparkSession.sparkContext
    table = context.broadcast(frequent(docs.select("doc_id", "text"), model))  # TABLE short strings at most
    shared = context.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(shared.value, table.value)
        for batch in batches:
            texts = batch.column("text")
            n = np.fromiter((counting.count(t) if t else 0 for t in texts.to_pylist()), np.int64, len(texts))
            size = texts.cast(pa.large_binary()).fill_null(b"")
            bytes_of = np.diff(np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]) if len(size) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bytes_of), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
