"""Token-ID files with Elias-Fano document boundaries (operator 6).

A corpus is a folder of shard files and a manifest. Documents are dealt to shards by range of their id
and written in ascending order (null ids first, equal ids by text hash), so the shards in order are one
array of token ids. A shard file holds

    ids           one little-endian unsigned integer per token, 2 bytes if the vocabulary allows, else 4
    doc ids       Elias-Fano coded, relative to the shard's smallest
    ends          Elias-Fano coded: where each document's ids end in the shard
    footer        JSON with the sizes of these sections, its length in 4 bytes, and MAGIC

Elias-Fano keeps the low bits of each value packed and the high bits in unary: about 2 + log2(tokens per
document) bits for a boundary. Counts of ones before each block of 512 bits make its select structure;
no table of 64-bit offsets is stored or built. The number of ids in earlier shards is in the manifest.

A task streams its shard, under a name of its own attempt, and returns that name: a lost or repeated
task leaves a stray file that no manifest lists. Null and empty texts have the end id alone. Repeated
rows are written as often as they occur; other columns are not looked at; an empty table makes a
manifest without shards.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import shared_folder, slices, table, tidy

MAGIC = b"EFTOKEN1"
BLOCK = 512
END_ID = 0
# Encoded pieces a task remembers, and bytes of text handled at a time.
REMEMBER = 300_000
SLICE = 1 << 20
# Token ids read at a time.
READ_IDS = 4 << 20


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Hadoop writes file:/x for file:///x."""
    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


class EliasFano:
    """A non-decreasing sequence of integers from 0 up."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        """``low`` and ``high``: packed bits as bytes."""
        self.n, self.low_bits, self.low = n, low_bits, low
        self.high = np.concatenate([high, np.zeros(-len(high) % (BLOCK // 8), np.uint8)]).reshape(-1, BLOCK // 8)
        ones = np.bitwise_count(self.high).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        bits = np.zeros(n + (most >> low_bits) + 1, np.uint8)
        bits[(values >> low_bits) + np.arange(n)] = 1
        digits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        return cls(n, low_bits, np.packbits(digits.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"))

    def dump(self) -> tuple[dict, bytes]:
        low, high = self.low.tobytes(), self.high.tobytes()
        return {"n": self.n, "low_bits": self.low_bits, "low": len(low), "high": len(high)}, low + high

    @classmethod
    def load(cls, head: dict, data: bytes) -> EliasFano:
        low = np.frombuffer(data, np.uint8, head["low"])
        return cls(head["n"], head["low_bits"], low, np.frombuffer(data, np.uint8, head["high"], head["low"]))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The k-th values."""
        block = np.searchsorted(self.before, k, side="right") - 1
        bits = np.unpackbits(self.high[block], axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, axis=1, dtype=np.uint16) > (k - self.before[block])[:, None], axis=1)
        out = (block * BLOCK + inside - k) << self.low_bits
        for d in range(self.low_bits):
            at = k * self.low_bits + d
            out |= ((self.low[at >> 3] >> (at & 7)).astype(np.int64) & 1) << d
        return out


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves,
    the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class Pieces(dict):
    """Ids of the pieces of text between blanks, found when first asked for.

    A piece of letters and trailing signs is two words, which go straight to the tokenizer's model; any
    other piece goes through the whole tokenizer.
    """

    WORD = re.compile(r"( ?[^\W\d_]+)((?:[^\w\s]|_)*)")
    LETTERS = _byte_letters()

    def __init__(self, tokenizer):
        super().__init__()
        self.signs = {"": b""}
        word_ids, letters, form = tokenizer.model.tokenize, self.LETTERS, self.WORD.fullmatch

        def whole(x: str) -> bytes:
            return np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()

        def sign(x: str) -> bytes:
            if x not in self.signs:
                self.signs[x] = whole(x)
            return self.signs[x]

        def line(x: str) -> bytes | None:
            """None if the line is not of the form."""
            m = form(x)
            if not m:
                return None
            word, signs = m.groups()
            ids = self.get(word)
            if ids is None:
                if not word.lstrip(" ").isalpha():
                    return None
                written = word if word.isascii() else word.encode().decode("latin-1")
                ids = self[word] = array("I", [t.id for t in word_ids(written.translate(letters))]).tobytes()
            return ids + sign(signs) if signs else ids

        def find(x: str) -> bytes:
            if "\n" not in x:
                found = line(x)
                return whole(x) if found is None else found
            lines = [line(y) for y in x.split("\n")]
            return whole(x) if None in lines else sign("\n").join(lines)

        self.find = find

    def __missing__(self, x: str) -> bytes:
        out = self[x] = self.find(x)
        return out


class PieceEncoder:
    """Encodes texts with a tokenizer, remembering the ids of pieces between blanks.

    A byte-level pre-tokenizer begins a new word at a blank, except inside longer white space; texts that
    hold a blank between white space, or a special token, are encoded whole, as are all texts of other
    tokenizers.
    """

    def __init__(self, tokenizer):
        """``tokenizer``: a Tokenizer or the path of its file."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer) if isinstance(tokenizer, str) else tokenizer
        before = self.tokenizer.pre_tokenizer
        plain = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        self.by_piece = plain and self.tokenizer.normalizer is None and isinstance(self.tokenizer.model, BPE)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r"\s \s", *map(re.escape, special)]))
        self.known = Pieces(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        known, out = self.known, []
        for t in texts:
            if not self.by_piece or self.whole.search(t):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            first, *rest = t.split(" ")
            out.append(b"".join([known[first], *[known[" " + x] for x in rest]]))
        return out


def _write(folder: str, tokenizer, end_id: int, width: int):
    """``tokenizer`` is a broadcast one: a worker makes it once, and its memory does not grow from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.eft"
        out, path = place(folder)
        encoder, end = PieceEncoder(tokenizer.value), np.array([end_id], "<u4").tobytes()
        lengths: list[np.ndarray] = []
        ids: list[pa.Array] = []
        file = None
        for batch in batches:
            if file is None:
                file = out.open_output_stream(f"{path}/{name}")
            ids.append(batch.column(0).cast(pa.int64()))
            for part in slices(batch.column(1), SLICE):
                codes = [x + end for x in encoder.encode([(t or b"").decode() for t in part])]
                lengths.append(np.array([len(x) // 4 for x in codes], np.int64))
                file.write(np.frombuffer(b"".join(codes), "<u4").astype(f"<u{width}").tobytes())
        if file is None:
            return
        keys = pa.concat_arrays(ids)
        values = keys.drop_null().to_numpy()
        ends = np.cumsum(np.concatenate(lengths))
        least = int(values[0]) if len(values) else 0
        footer = {"width": width, "tokens": int(ends[-1]), "nulls": keys.null_count, "least": least, "sections": []}
        for x in (values - least, ends):
            head, data = EliasFano.of(x).dump()
            footer["sections"].append(head)
            file.write(data)
        tail = json.dumps(footer).encode()
        file.write(tail + len(tail).to_bytes(4, "little") + MAGIC)
        file.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": [task.partitionId()], "file": [name], "docs": [len(keys)], "tokens": [int(ends[-1])]},
            schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    return run


def write_corpus(
    docs: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    shards: int | None = None,
) -> dict:
    """Write the documents' token ids in ascending id order; returns the manifest, which it writes too.

    ``shards``: number of ranges of the id, by default the session's number of shuffle partitions. Ids are
    integers. Needs a folder that every executor reaches.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Tokenizer.from_file(tokenizer)
    width = 2 if max(model.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("tie"))
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc()]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")
    out, path = place(folder)
    out.create_dir(path, recursive=True)
    written = dealt.mapInArrow(tidy(_write(folder, spark.sparkContext.broadcast(model), end_id, width)), "shard int, file string, docs long, tokens long")
    # One row for each shard, so what reaches the driver is bounded by the number of partitions.
    listed, start = [], 0
    for r in sorted(written.collect(), key=lambda r: r["shard"]):
        listed.append({"file": r["file"], "docs": r["docs"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    manifest = {"format": MAGIC.decode(), "end_id": end_id, "tokens": start, "shards": listed}
    with out.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """Random access to a shard file."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        file.seek(size - 12)
        tail = file.read(12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(tail[:4], "little")
        file.seek(size - 12 - length)
        self.footer = json.loads(file.read(length))
        self.width = self.footer["width"]
        at, parts = self.footer["tokens"] * self.width, []
        for head in self.footer["sections"]:
            file.seek(at)
            parts.append(EliasFano.load(head, file.read(head["low"] + head["high"])))
            at += head["low"] + head["high"]
        self.keys, self.ends = parts

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where documents first..last - 1 begin in the shard, and where the last of them ends."""
        ends = self.ends.select(np.arange(max(first - 1, 0), last))
        return ends if first else np.concatenate([[0], ends])

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = self.footer["nulls"]
        held = self.keys.select(np.arange(max(first - nulls, 0), max(last - nulls, 0))) + self.footer["least"]
        return [None] * max(0, min(last, nulls) - first) + held.tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}").astype("<u4")


def _read(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, path = place(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with src.open_input_file(f"{path}/{name}") as f:
                    shard = Shard(f)
                    for first in range(0, shard.ends.n, 4096):
                        last = min(first + 4096, shard.ends.n)
                        at, keys, k = shard.bounds(first, last), shard.doc_ids(first, last), 0
                        while k < len(keys):  # as many documents as READ_IDS ids hold, one at least
                            z = max(k + 1, int(np.searchsorted(at, at[k] + READ_IDS, side="right")) - 1)
                            ids = shard.ids(int(at[k]), int(at[z]))
                            each = np.split(ids, at[k + 1 : z] - at[k])
                            columns = {
                                "doc_id": pa.array(keys[k:z], pa.int64()), "start": pa.array(at[k:z] + base, pa.int64()),
                                "n_tokens": pa.array(np.diff(at[k : z + 1]), pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                            }
                            if with_ids:
                                columns["ids"] = pa.array([x.tolist() for x in each], pa.list_(pa.int32()))
                            yield pa.RecordBatch.from_pydict(columns)
                            k = z

    return run


def read_corpus(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), and the ids if asked."""
    src, path = place(folder)
    with src.open_input_stream(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    if manifest["format"] != MAGIC.decode():
        raise ValueError("not a token corpus")
    files = [(s["file"], s["start"]) for s in manifest["shards"]]
    rows = spark.createDataFrame(files, "file string, start long").repartition(max(1, len(files)))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(tidy(_read(folder, with_ids)), kind)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens_of(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The documents, written to a new corpus in the shared folder and read back."""
    folder = shared_folder(docs.sparkSession) + "-tokens"
    write_corpus(docs, folder, tokenizer or tokenizer_path())
    return read_corpus(docs.sparkSession, folder)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"))
