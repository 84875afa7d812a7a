"""Token counts without token ids.

A document's words (cut at ASCII white space, where no token can span) are
counted first; each distinct word is given to the tokenizer once and only the
*number* of its pieces is kept; the document's count is the sum of frequency
times pieces.  The join of frequencies and piece counts is a hash join inside
the task against a bounded table: a word met again in the partition costs a
look-up.  Nothing is shuffled, so no frequent word can make a partition hot,
and a lost task is rerun from its input split alone.

Exactness rests on the tokenizer cutting at white space before it merges and
on its special strings holding none: then the pieces of a text are those of its
words.  ``cuts_at_space`` probes that for the tokenizer at hand, and texts of a
tokenizer that fails are encoded whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a very long text
is taken apart at spaces, a megabyte at a time; rows map one to one, so ties,
repeated rows, null keys and empty tables need nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Most words whose piece counts a task remembers; the table starts anew when full.
REMEMBERED = 300_000
PART = 1 << 20
BLOCK = 1 << 21


def load(path: str | None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts_at_space(tokenizer) -> bool:
    """Whether pieces never span a blank, judged on probes."""
    whole = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
    probes = ["the end", "a b c", " x", "x ", "it 's", "1 2", "! !", "é é", "a  b", "end\nof\tline"]
    return all(whole(p) == sum(whole(w) for w in p.split()) for p in probes)


def words_of(text: str) -> Iterator[list[str]]:
    """The words between blanks, tabs and line ends, in parts of bounded size."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PART else text.find(" ", at + PART)
        end = len(text) if end < 0 else end
        part = text[at:end].replace("\n", " ").replace("\t", " ").replace("\r", " ")
        yield part.split(" ")
        at = end


class Counts:
    """Pieces of words, each counted once while it is remembered."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.pieces: dict[str, int] = {"": 0}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.pieces]
        if len(self.pieces) + len(new) > REMEMBERED:
            self.pieces = {"": 0}
            new = [w for w in words if w]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.pieces.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))

    def of_block(self, frequencies: list[Counter]) -> list[int]:
        self.learn(set().union(*frequencies))
        pieces = self.pieces
        return [sum(n * pieces[w] for w, n in f.items()) for f in frequencies]

    def of_texts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        block: list[Counter] = []
        size = 0
        for text in texts:
            if text and len(text) > PART:  # its parts are summed by themselves
                out += self.of_block(block)
                block, size = [], 0
                out.append(sum(self.of_block([Counter(part)])[0] for part in words_of(text)))
                continue
            block.append(Counter(next(words_of(text)) if text else ()))
            size += len(text or "")
            if size > BLOCK:
                out += self.of_block(block)
                block, size = [], 0
        return out + self.of_block(block)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_bytes and n_tokens of every row of ``df``.

    ``path`` is the tokenizer's file (on every worker); by default the public
    vocabulary ``VOCABULARY``.
    """
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = load(path)
        counts = Counts(tokenizer) if cuts_at_space(tokenizer) else None
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            if counts:
                n_tokens = counts.of_texts(texts.to_pylist())
            else:
                n_tokens = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def count_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The ``op9`` digest."""
    return token_counts(docs, path=path).withColumn("over_limit", F.col("n_tokens") > limit)
