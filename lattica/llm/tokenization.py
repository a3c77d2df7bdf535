"""Token ids in Arrow IPC files of equal-length sequences.

Documents are ordered by id in range partitions. Each partition writes one file
in the Arrow file format: record batches of rows with

    ids   fixed_size_list<uint16 or uint32>[seq_len]   token ids, 0-padded
    mask  fixed_size_list<bool>[seq_len]               false where padded
    docs  list<struct<doc_id, end>>                    documents that end here

A document's ids, with the end id after them, follow the one before; sequences
run on across documents and only a file's last sequence is padded. ``end`` is
the place just behind the end id, since the end id may also occur in a text.
Buffers aren't compressed, so a memory-mapped file gives any sequence or mask
without a copy.

Tokenizing. The byte-level splitter never joins what a blank separates, so a
text is cut into pre-tokens by a regular expression, each distinct one is
encoded once by the tokenizers library and kept in a bounded cache. Texts for
which that isn't certain to be the same (unusual white space, special tokens)
are encoded whole.

A null text is empty: it has the end id only. Documents with equal ids are
ordered by the text's hash (ties). Null ids sort first. Repeated rows are written
each. Very long texts run on over as many sequences as they need. An empty table
gives no files and no rows. Other columns aren't written.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import shared_path, table, text_chunks

#: Pre-tokens of the byte-level splitter, but for its look-ahead on white space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\pL+| ?\pN+| ?[^\s\pL\pN]+|\s+"
#: Texts with two white-space characters in a row, with one that isn't ASCII,
#: with a NUL or with a special token's opening are encoded whole.
WHOLE = r"\s\s|[\x00\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
CACHE = 900_000
SEQ_LEN = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes Arrow strings into one flat array of ids and the texts' lengths."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.cache: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        cache = self.cache
        new = [p for p in pieces if p not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = pieces
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            cache.update(zip(part, self._ids(part)))
        return [cache[p] for p in pieces]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(t, WHOLE).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring_regex(pc.if_else(pa.array(whole), "", t), pattern=PRETOKEN, replacement="\\0\x00")
        lists = pc.split_pattern(marked, "\x00")
        per_doc = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        d = lists.flatten().dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False)
        parts = self._pieces(d.dictionary.to_pylist()) if len(d.dictionary) else []
        size = np.array([len(p) for p in parts], np.int64) // 4
        flat = np.frombuffer(b"".join(parts), np.uint32)
        first = np.cumsum(size) - size
        n = size[codes]
        at = np.cumsum(n) - n
        ids = flat[np.repeat(first[codes] - at, n) + np.arange(n.sum())]
        row = np.repeat(np.arange(len(per_doc)), per_doc)
        lengths = np.bincount(row, weights=n, minlength=len(per_doc)).astype(np.int64)
        if whole.any():
            rows = np.flatnonzero(whole)
            long = self._ids(t.take(pa.array(rows)).to_pylist())
            out = np.split(ids, np.cumsum(lengths)[:-1])
            for r, x in zip(rows.tolist(), long):
                out[r] = np.frombuffer(x, np.uint32)
            lengths[rows] = [len(x) // 4 for x in long]
            ids = np.concatenate(out)
        return ids, lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This process's encoder; its cache serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _File:
    """Writes sequences to one Arrow file in the shared folder."""

    def __init__(self, uri: str, name: str, seq_len: int, wide: bool) -> None:
        import pyarrow as pa
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path, recursive=True)
        from pyspark import TaskContext

        # The name appears when the file is whole; a task that runs twice replaces its file by an equal one.
        self.system, self.path, self.part = system, f"{path}/{name}", f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.seq_len, self.dtype = seq_len, np.uint32 if wide else np.uint16
        doc = pa.struct([("doc_id", pa.int64()), ("end", pa.int32())])
        self.schema = pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len)), ("docs", pa.list_(doc))])
        self.sink = system.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.have = self.written = 0
        self.ends: list[tuple[int | None, int]] = []

    def add(self, ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> None:
        self.ends += zip(doc_ids, (ends + self.have + self.written).tolist())
        self.ids.append(ids.astype(self.dtype))
        self.have += len(ids)
        if self.have >= 1024 * self.seq_len:
            self._flush(self.have // self.seq_len * self.seq_len)

    def _flush(self, n: int) -> None:
        import pyarrow as pa

        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, self.dtype)
        rows = -(-n // self.seq_len)
        out, rest = np.zeros(rows * self.seq_len, self.dtype), ids[n:]
        out[: min(n, len(ids))] = ids[:n]
        mask = np.zeros(rows * self.seq_len, bool)
        mask[:n] = True
        upto = self.written + n
        k = next((i for i, (_, e) in enumerate(self.ends) if e > upto), len(self.ends))
        done, self.ends = self.ends[:k], self.ends[k:]
        seq = np.array([(e - self.written - 1) // self.seq_len for _, e in done], np.int64)
        offsets = np.zeros(rows + 1, np.int32)
        np.cumsum(np.bincount(seq, minlength=rows)[:rows], out=offsets[1:])
        docs = pa.StructArray.from_arrays([pa.array([i for i, _ in done], pa.int64()), pa.array([(e - self.written - 1) % self.seq_len + 1 for _, e in done], pa.int32())], fields=list(self.schema.field("docs").type.value_type))
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(out), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len), pa.ListArray.from_arrays(pa.array(offsets), docs)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.written, self.ids, self.have = upto, [rest], len(rest)

    def close(self) -> None:
        if self.have:
            self._flush(self.have)
        self.writer.close()
        self.sink.close()
        from pyarrow import fs

        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)
        self.system.move(self.part, self.path)

    def drop(self) -> None:
        """Removes what a failed task has written."""
        self.sink.close()
        self.system.delete_file(self.part)


def write_sequences(docs: DataFrame, out: str, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", end_id: int = 0, seq_len: int = SEQ_LEN, partitions: int | None = None) -> DataFrame:
    """Writes ``docs`` by ascending ``key``; returns (part, path, tokens, documents), a row a file."""
    tokenizer = tokenizer or default_tokenizer()

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, file, tokens, n = encoder_of(tokenizer), None, 0, 0
        try:
            for batch in batches:
                for b in text_chunks(batch, "t"):
                    file = file or _File(out, f"part-{part:06d}.arrow", seq_len, encoder.wide)
                    ids, lengths = encoder.encode(b.column("t"))
                    ends = np.cumsum(lengths + 1)
                    file.add(np.insert(ids, np.cumsum(lengths), end_id), b.column("k").to_pylist(), ends)
                    tokens, n = tokens + int(ends[-1]), n + b.num_rows
        except BaseException:
            if file:
                file.drop()
            raise
        if file:
            file.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [file.path], "tokens": pa.array([tokens], pa.int64()), "documents": pa.array([n], pa.int64())})

    # Rows of one id (or of none) may be many: their hash spreads them over files.
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    n = (partitions,) if partitions else ()
    return rows.repartitionByRange(*n, "k", "h").sortWithinPartitions("k", "h", "t").mapInArrow(write, "part int, path string, tokens long, documents long")


def read_sequences(spark: SparkSession, files: DataFrame, uri: str) -> DataFrame:
    """Reads files of write_sequences() back: (doc_id, start, n_tokens, ids_crc32), a row a document."""

    def read(batches) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        system = fs.FileSystem.from_uri(uri)[0]
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                local = isinstance(system, fs.LocalFileSystem)
                with pa.memory_map(path) if local else system.open_input_file(path) as source:
                    reader = pa.ipc.open_file(source)
                    rest = np.zeros(0, np.uint32)
                    for k in range(reader.num_record_batches):
                        b = reader.get_batch(k)
                        seq_len = b.schema.field("ids").type.list_size
                        ids = b.column("ids").flatten().to_numpy(zero_copy_only=False)
                        real = b.column("mask").flatten().to_numpy(zero_copy_only=False)
                        docs = b.column("docs")
                        row = np.repeat(np.arange(b.num_rows), pc_len(docs))
                        flat = docs.flatten()
                        end = row * seq_len + flat.field("end").to_numpy(zero_copy_only=False)
                        stream = np.concatenate([rest, ids[real].astype("<u4")])
                        cut = end + len(rest)
                        begin = np.concatenate([[0], cut[:-1]]) if len(cut) else cut
                        crc = [zlib.crc32(stream[x:y].tobytes()) for x, y in zip(begin.tolist(), cut.tolist())]
                        if len(cut):
                            yield pa.RecordBatch.from_arrays([flat.field("doc_id"), pa.array(start + begin, pa.int64()), pa.array(cut - begin, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            start += int(cut[-1])
                            rest = stream[cut[-1] :]
                        else:
                            rest = stream

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pc_len(lists) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def encode_and_read_back(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """Writes the files to the shared folder and returns what they hold, a row a document."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    out = shared_path(spark, "tokens")
    uri = out if "://" in out or ":/" in out else f"file://{out}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    index = out + "-index"
    write_sequences(docs, uri, tokenizer, text, key, seq_len=seq_len).write.parquet(index)
    files = spark.read.schema("part int, path string, tokens long, documents long").parquet(index)
    # One row a file: where each begins.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("path", "start")
    # A number of its own, else the few small rows would be merged into one task.
    return read_sequences(spark, files.repartition(max(1, files.count()), "path"), uri)


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    return encode_and_read_back(table(spark, sf_dir, "documents").select("doc_id", "text"))
