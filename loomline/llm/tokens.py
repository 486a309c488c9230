"""Token ids of a whole corpus by a public byte-level BPE tokenizer.

The words of all documents are counted; the most frequent ones are encoded once on the driver and compiled into
a lexicon (see lexicon.py), which workers map into memory. A worker looks each word of a batch up once; words
that the lexicon lacks are merged exactly, by the tokenizer's own merge ranks. A word is what the tokenizer's
pattern cuts from the text, so the ids are those of the tokenizer itself.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.batches import slices
from loomline.llm.lexicon import Lexicon, compile_lexicon
from loomline.session import scratch_path, spread

#: Most words of a lexicon, and how often a word must occur to be in it.
MAX_WORDS, MIN_COUNT = 50_000, 8
#: Bytes of the longest word that is counted, and the most words a worker keeps beside the lexicon.
LONGEST, KEPT_WORDS = 64, 300_000

# The tokenizer's pattern, and the same for texts of ASCII characters alone, where `re` can stand in (fixed values).
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Merger:
    """Exact merges of single words by the ranks in a vocabulary file of lines `base64 rank`."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = public_tokenizers.PATTERN
        self.any_text = regex.compile(self.pattern).findall
        self.ascii_text = _ASCII.findall
        self._merge = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece

    @classmethod
    def of(cls, vocabulary: str) -> Merger:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = cls(vocabulary)
        return _encoders[vocabulary]

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.ascii_text(text) if text.isascii() else self.any_text(text)

    def ids(self, word: bytes) -> list[int]:
        one = self.ranks.get(word)
        return [one] if one is not None else list(self._merge(word))


class Encoder:
    """Words of a worker process: the lexicon, and a bounded table of words met so far."""

    def __init__(self, vocabulary: str, lexicon: str):
        self.merger, self.lexicon, self.known = Merger.of(vocabulary), Lexicon(lexicon), {}

    def learn(self, new: set[str]) -> None:
        words = list(new)
        raw = [w.encode() for w in words]
        for w, b, i in zip(words, raw, self.lexicon.find(raw).tolist()):
            self.known[w] = self.lexicon.ids_of(i) if i >= 0 else self.merger.ids(b)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where the ids of each text begin and end."""
        cut = [self.merger.words(t) for t in texts]
        everything = set(chain.from_iterable(cut))
        new = everything - self.known.keys()
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = everything
        self.learn(new)
        get, flat, ends = self.known.__getitem__, [], [0]
        for words in cut:
            flat.extend(chain.from_iterable(map(get, words)))
            ends.append(len(flat))
        return np.array(flat, np.int32), np.array(ends, np.int32)


def count_words(docs: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """(word binary, n): how often each word of up to LONGEST bytes occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, merger = Counter(), Merger.of(vocabulary)

        def out() -> Iterator[pa.RecordBatch]:
            pairs = [(b, n) for b, n in ((w.encode(), n) for w, n in words.items()) if len(b) <= LONGEST]
            words.clear()
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in pairs], pa.binary()), pa.array([n for _, n in pairs], pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words.update(merger.words(t))
            if len(words) > KEPT_WORDS:
                yield from out()
        yield from out()

    return spread(docs.select(text)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str, vocabulary: str, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> str:
    """Compile the max_words most frequent words of all documents; returns the name workers know the file by."""
    spark = docs.sparkSession
    frequent = count_words(docs, text, vocabulary).where(F.col("n") >= min_count).orderBy(F.desc("n"), "word").limit(max_words)
    merger = Merger.of(vocabulary)
    entries = {bytes(r.word): merger.ids(bytes(r.word)) for r in frequent.select("word").collect()}  # at most max_words
    path = scratch_path(spark, "lexicon")
    data = compile_lexicon(entries)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def encode(docs: DataFrame, text: str, keep: list[str], vocabulary: str | None = None, lengths_only: bool = False) -> DataFrame:
    """The columns in keep, and `ids` array<int> (or `n_tokens` long) of the text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list (0).
    Very long texts are encoded whole. Rows are kept one for one.
    """
    vocabulary = vocabulary or default_vocabulary()
    lexicon = build_lexicon(docs, text, vocabulary)
    kept = [f.name for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, SparkFiles.get(lexicon))
        for batch in slices(batches, len(kept)):
            flat, ends = encoder.encode(batch.column(len(kept)).to_pylist())
            last = pa.array(np.diff(ends).astype(np.int64)) if lengths_only else pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], last], [*kept, "n_tokens" if lengths_only else "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return spread(docs.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, f"{schema}, {'n_tokens long' if lengths_only else 'ids array<int>'}")
