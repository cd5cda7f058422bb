"""Token counts of whole texts, huge ones by overlap resynchronisation.

A huge text is encoded in chunks that overlap, with offsets. Two neighbouring
chunks are spliced at a place in their overlap where both begin a pre-token: from
a common beginning on, the pre-tokeniser's left-to-right scan goes on alike in
both, and the merges stay within a pre-token, so the splice is exact. The place
must also keep a margin from the left chunk's end (what stands behind a pre-token
can change where it ends) and from the right chunk's start. If there is none, the
overlap is widened until the chunks align or one chunk holds all the rest.

Texts below the huge size go to the library whole or, where the vocabulary file
proves that counts add up over pre-tokens, as pre-tokens whose counts a worker
keeps in a bounded store.

Edge cases: null counts as empty (0 bytes, 0 tokens); repeated rows are counted
each on its own; special strings inside a text are single tokens, the library's
default. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, MARGIN = 1 << 14, 1 << 9, 1 << 6
HUGE = 1 << 15
STORE = 400_000


class Counter:
    """Counts tokens with one vocabulary file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.kept: dict[str, int] = {}
        self.split = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.pieces, self.library = None, Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens") or [])
        #: No normaliser, byte-level pre-tokens by the usual pattern, merges within them: counts add up over pre-tokens.
        self.additive = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout") and plain
        if self.additive:
            import public_tokenizers
            import regex

            self.split = regex.compile(public_tokenizers.PATTERN)

    def whole(self, text: str) -> int:
        if self.pieces is not None:
            return len(self.pieces.encode(text, num_threads=1))
        return len(self.library.encode(text, add_special_tokens=False))

    def encoded(self, text: str, at: int) -> list[tuple[int, int, bool]]:
        """(start, end, begins a pre-token) of each token of a chunk that begins at ``at``."""
        e = self.library.encode(text, add_special_tokens=False)
        out, last = [], object()
        for (a, b), word in zip(e.offsets, e.word_ids, strict=True):
            out.append((at + a, at + b, word is None or word != last))
            last = word if word is not None else object()
        return out

    def chunked(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a huge text, spliced from overlapping chunks."""
        total, start, begin = 0, 0, 0  # tokens so far; where the current chunk starts; from where it counts
        left = self.encoded(text[: chunk + overlap], 0)
        end = min(len(text), chunk + overlap)
        while end < len(text):
            wide, joint = overlap, None
            while joint is None:
                after = max(start, end - 2 * wide)
                right_end = min(len(text), after + chunk + 2 * wide)
                right = self.encoded(text[after:right_end], after)
                low, high = max(begin, after + MARGIN if after else 0), end - MARGIN
                starts = {a for a, _, first in right if first and low <= a <= high}
                joint = max((a for a, _, first in left if first and a in starts), default=None)
                if joint is None or joint <= begin:
                    joint = None
                    wide *= 2
                    if end - 2 * wide <= begin:  # take all from where the count stands, with a longer chunk
                        end = min(len(text), end + 2 * wide)
                        left = self.encoded(text[start:end], start)
                        wide = overlap
                        if end == len(text):
                            return total + sum(a >= begin for a, _, _ in left)
            total += sum(begin <= a < joint for a, _, _ in left)
            start, begin, left, end = after, joint, right, right_end
        return total + sum(a >= begin for a, _, _ in left)

    def _pretokens(self, text: str) -> int:
        n, kept = 0, self.kept
        for word in self.split.findall(text):
            c = kept.get(word)
            if c is None:
                c = self.whole(word)
                if len(kept) < STORE and len(word) < 64:
                    kept[word] = c
            n += c
        return n

    def count(self, text: str | None, huge: int = HUGE) -> int:
        if not text:
            return 0
        if self.pieces is None and len(text) >= huge:
            return self.chunked(text)
        if self.split is None or any(s in text for s in self.special):
            return self.whole(text)
        return self._pretokens(text)


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_count(text: Column, file: str = "byte_bpe_50k.json", huge: int = HUGE) -> Column:
    """The number of tokens of a text; the vocabulary file is found by its name on each executor."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        c = counter(file if os.path.isabs(file) else vocabulary(file))
        return pd.Series([c.count(x if isinstance(x, str) else None, huge) for x in texts], dtype="int64")

    return of(text)


def counted(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit."""
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col(text_col), file).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
