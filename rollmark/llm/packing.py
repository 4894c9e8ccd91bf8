"""Packing by concatenation and cutting.

Pass one tokenises each partition in order and stores, with every document, its token ids
(16 bits each where the vocabulary allows) and its offset within the partition. A second,
tiny job sums the partition totals; their prefix sums (one number per partition) turn local
offsets into global ones. Pass two cuts every document at the multiples of the sequence
length: a document that crosses a boundary gets a record on either side of it. Nothing is
shuffled, and every sequence but the last is full.

The stored table pins partitions and order, so both passes agree even when tasks are run
again or executors are lost between them.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import claim, documents, narrow, saved

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A run of letters, or a run of anything else. Between the two the tokenizer's words always end.
RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+")


class SafeCharacters(dict):
    """Whether a character may be split and lower-cased here as the tokenizer does it.

    Each character is tried once on the tokenizer itself, as the two may follow different versions of
    Unicode. Marks and conjoining letters, which join with what stands before them, never may, nor
    the sigma, whose lower case depends on what follows.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.normalise = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, c: str) -> bool:
        low, kind = c.lower(), unicodedata.category(c)
        if c == "Σ" or kind[0] in "MC" or "\u1100" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7fb":
            safe = False
        elif c.isalpha():
            safe = len(low) == 1 and low.isalpha() and self.normalise(c) == low and len(self.split("a" + low)) == 1
        else:
            pieces = self.split(f"a{c}a")
            safe = self.normalise(c) in (c, " ") and len(pieces) > 1 and pieces[0][1][1] == 1 and pieces[-1][1][0] == 1 + len(c)
        self[c] = safe
        return safe


class WordCache(dict):
    """The ids of white-space separated words, packed as bytes; up to ``limit`` words are kept, and
    as many of those before them.

    A new word is put together from its runs of letters and of other characters, which repeat
    far more often than whole words. Runs of letters go to the byte-level model directly, others
    to the whole tokenizer. So do words as a whole that hold an apostrophe (the tokenizer's contractions
    hold letters), an added token's string, or a character that is not safe.
    """

    def __init__(self, tokenizer, limit: int = 300_000):
        super().__init__()
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        self.kind = "<u2" if tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.pack = "H" if self.kind == "<u2" else "I"
        self.older: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.bytes = byte_alphabet()
        # only with the normaliser and the splits that the short cuts stand for
        state = json.loads(tokenizer.to_str())
        kinds = [x["type"] for x in (state.get("normalizer") or {}).get("normalizers", [])]
        splits = [x["type"] for x in (state.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        added = [x["content"] for x in state.get("added_tokens") or []]
        self.short_cuts = kinds == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]
        self.by_words = not any(c.isspace() for x in added for c in x)
        self.apart = re.compile("|".join(["'", *(re.escape(x) for x in added if x)]), re.IGNORECASE)
        self.safe = SafeCharacters(tokenizer) if self.short_cuts else {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            if not word:
                found = b""
            elif self.short_cuts and not self.apart.search(word) and (word.isascii() and word.isprintable() or all(map(self.safe.__getitem__, word))):
                get, run = self.runs.get, self._run
                found = b"".join([get(r) or run(r) for r in RUNS.findall(word)])
            else:
                found = self._whole(word)
        self[word] = found
        return found

    def _whole(self, text: str) -> bytes:
        return array(self.pack, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        if run.isalpha():
            low = run.lower()
            if not low.isascii():
                low = "".join(map(self.bytes.__getitem__, low.encode()))
            found = array(self.pack, [t.id for t in self.model.tokenize(low)]).tobytes()
        else:
            found = self._whole(run)
        if len(self.runs) >= self.limit:
            self.runs.clear()
        self.runs[run] = found
        return found


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, all other bytes, in order, for those from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_CACHES: dict[str, WordCache] = {}


def tokenizer_cache(name: str) -> WordCache:
    """The words of a `tokenizers` file (a name of public_tokenizers, or a path); one per worker."""
    if name not in _CACHES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if "/" in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _CACHES[name] = WordCache(Tokenizer.from_file(path))
    return _CACHES[name]


def encode_texts(texts: list[str], cache: WordCache) -> list[bytes]:
    """Ids of whole texts, as ``encode(text, add_special_tokens=False)`` gives them. The vocabulary
    drops white space, so words are encoded one by one."""
    if not cache.by_words:
        return [cache._whole(t) for t in texts]
    return [b"".join(map(cache.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    length: int = 2048,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: id, start in the document, length, CRC-32 of its ids,
    tokens of the document, sequence and offset in the sequence; ``with_ids`` adds the ids.

    Each document is its ids followed by ``end_id``; the string of a special token in a text gives the
    id of that token, as the tokenizer does by default. A null or empty text is the end id alone.
    Null ids and repeated rows are documents like any other. An empty table gives no pieces.
    Columns other than id and text are ignored. ``tokenizer`` must drop white space.
    """
    source = narrow(docs, id_col, text_col)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        claim("packing", _CACHES.clear)
        cache = tokenizer_cache(tokenizer)
        end = np.array([end_id], dtype=cache.kind).tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                cut = batch.slice(begin, 256)
                blobs = [ids + end for ids in encode_texts(cut.column("text").to_pylist(), cache)]
                sizes = np.array([len(b) // len(end) for b in blobs], dtype=np.int64)
                local = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(local), pa.array(sizes), pa.array(blobs, pa.binary())],
                    ["doc_id", "part", "local", "n", "ids"],
                )

    stored = saved(source.mapInArrow(tokenise, "doc_id long, part int, local long, n long, ids binary"))
    totals = {r["part"]: r["total"] for r in stored.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            rows = zip(*(batch.column(k).to_pylist() for k in ("doc_id", "part", "local", "n", "ids")), strict=True)
            for doc_id, part, local, n, blob in rows:
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                begin = base[part] + local
                start = 0
                while start < n:
                    offset = (begin + start) % length
                    size = min(length - offset, n - start)
                    piece = ids[start : start + size]
                    values = (doc_id, start, size, zlib.crc32(piece.tobytes()), n, (begin + start) // length, offset, piece)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                names.append("ids")
                arrays.append(pa.array([p.astype(np.int32) for p in columns[7]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return stored.mapInArrow(cut_up, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
