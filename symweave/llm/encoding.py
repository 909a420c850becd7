"""Encoding of a corpus with a public byte-level tokenizer."""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.lexicon import compile_words, numbers
from symweave.llm.pretokens import CHUNK
from symweave.session import ship, spread, stage

#: Where the public vocabularies lie; the same path on every executor.
TOKENIZERS = "/opt/tokenizers"
#: The lexicon holds at most this many words, each with and without a blank before it.
LEXICON_WORDS = 30_000
#: A worker forgets its words beyond this number.
CACHE_CHUNKS = 400_000


@cache
def tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The public tokenizer ``name``; special tokens are ordinary text."""
    import runpy

    import tiktoken

    pattern = runpy.run_path(f"{folder}/__init__.py")["PATTERN"]
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` of all blank-delimited words of all texts, summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if t:
                    seen.update(t.split())
            if len(seen) > CACHE_CHUNKS:
                yield pa.RecordBatch.from_pydict({"word": list(seen), "n": pa.array(seen.values(), pa.int64())})
                seen = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    ship(documents.sparkSession)
    return spread(documents.select(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_sent: set[tuple[str, str]] = set()


def build_lexicon(documents: DataFrame, text: str = "text", *, words: int = LEXICON_WORDS, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    """Compile the most frequent words of the corpus with their ids; returns the name under which executors find the file.

    Counts cover all texts. At most ``words`` words come to the driver, all the others are met by the exact
    merge: words are taken by whole levels of their count, most frequent first, as long as there is room. Equal lexicons are sent once. The automaton and the ids are one uncompressed array file, sent to the executors by Spark and mapped into memory there.
    """
    spark = documents.sparkSession
    counts = stage(word_counts(documents, text), "words")
    level = F.floor(F.log2("n") * 8).cast("int")  # under 512 levels for any count
    room, least = words, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["level"]
    top = [] if least is None else [r["word"] for r in counts.where(level >= least).select("word").collect()]
    keys = sorted({k.encode() for w in top for k in (w, " " + w)})
    encoder = tokenizer(folder, name)
    ids = [encoder.encode_ordinary(k.decode()) for k in keys]
    arrays = compile_words(keys)
    arrays |= {"at": np.cumsum([0, *map(len, ids)]).astype(np.int64), "ids": np.array([i for x in ids for i in x], np.int32)}
    order = ("key", "to", "skip", "final", "root", "at", "ids")
    sizes = np.array([len(arrays[k]) for k in order], np.int64)
    flat = np.concatenate([sizes, *[arrays[k].astype(np.int64) for k in order]])
    file = f"lexicon-{hashlib.sha256(flat.tobytes()).hexdigest()[:24]}.npy"
    if (spark.sparkContext.applicationId, file) not in _sent:
        target = Path(tempfile.mkdtemp(prefix="spark-lexicon-")) / file
        np.save(target, flat)
        spark.sparkContext.addFile(str(target))
        _sent.add((spark.sparkContext.applicationId, file))
    return file


@cache
def _mapped(file: str) -> dict[str, np.ndarray]:
    flat = np.load(SparkFiles.get(file), mmap_mode="r")
    order = ("key", "to", "skip", "final", "root", "at", "ids")
    out, at = {}, len(order)
    for k, n in zip(order, flat[: len(order)]):
        out[k] = flat[at : at + n]
        at += n
    out["final"] = out["final"].astype(bool)
    out["ids"] = out["ids"].astype(np.int32)
    return out


class Encoder:
    """Encodes chunks in one worker: its own cache, then the lexicon, then the exact merge."""

    def __init__(self, lexicon: str, folder: str, name: str):
        self.lexicon, self.exact, self.known = _mapped(lexicon), tokenizer(folder, name), {}

    def learn(self, new: list[str]) -> None:
        at, ids = self.lexicon["at"], self.lexicon["ids"]
        found = numbers(self.lexicon, [c.encode() for c in new]).tolist()
        exact = self.exact.encode_ordinary
        for chunk, number in zip(new, found):
            self.known[chunk] = (ids[at[number] : at[number + 1]] if number >= 0 else np.array(exact(chunk), np.int32)).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers, one after another; unknown chunks of all texts are looked up together."""
        split = [CHUNK.findall(t) if t else [] for t in texts]
        unknown = set().union(*split).difference(self.known)
        if unknown:
            if len(self.known) + len(unknown) > CACHE_CHUNKS:
                self.known.clear()
                unknown = set().union(*split)
            self.learn(list(unknown))
        known = self.known.__getitem__
        return [b"".join(map(known, chunks)) for chunks in split]


def _slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list]]:
    """(first row, texts) of pieces of a batch with about ``most`` characters, or one longer text."""
    out, size, first = [], 0, 0
    for i, t in enumerate(texts):
        out.append(t.as_py())
        size += len(out[-1] or "")
        if size > most:
            yield first, out
            out, size, first = [], 0, i + 1
    if out:
        yield first, out


def encode_corpus(documents: DataFrame, *, key: str = "doc_id", text: str = "text", lexicon: str | None = None, counts_only: bool = False, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``(key, ids)``: the token ids of every text, without special tokens; with ``counts_only`` ``(key, n_tokens)``.

    A lexicon of the corpus's frequent words (:func:`build_lexicon`) gives the ids of most words, words it lacks are merged
    exactly, so the result never depends on the lexicon. Null and empty texts get an empty list (0 tokens), never null. Blank
    texts are encoded like others. A text is encoded whole, however long. Repeated rows stay repeated. An empty table gives no rows. Extra
    columns are ignored; a null key is kept.
    """
    ship(documents.sparkSession)
    lexicon = lexicon or build_lexicon(documents, text, folder=folder, name=name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lexicon, folder, name)
        for batch in batches:
            keys = batch.column(0)
            for first, texts in _slices(batch.column(1)):
                parts = encoder.encode(texts)
                yield _batch(keys.slice(first, len(texts)), parts, [len(p) // 4 for p in parts])

    def _batch(keys: pa.Array, parts: list[bytes], lengths: list[int]) -> pa.RecordBatch:
        if counts_only:
            return pa.RecordBatch.from_arrays([keys, pa.array(lengths, pa.int32())], names=[key, "n_tokens"])
        values = pa.Array.from_buffers(pa.int32(), sum(lengths), [None, pa.py_buffer(b"".join(parts))])
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, values)], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key), F.col(text).cast("string"))
    return spread(rows).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens int" if counts_only else "ids array<int>"))
