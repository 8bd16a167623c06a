"""Token ids in files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

Ids are replaced by their rank in the corpus, the commonest first, so most need one byte. Each rank takes
one to four bytes; its length less one is two bits of a control byte, four ranks to a control byte, and the
control bytes of a file stand before the data bytes. Reading therefore is a lookup of four lengths for each
control byte, a running sum, and one gather per byte place, all in numpy.

A file, little-endian: magic, documents, tokens, data bytes (4 x 8 bytes); ids of the documents (8
bytes each) and a null mark for each (1 byte); tokens of each document (8 bytes); control bytes; data bytes.
Files hold whole documents in ascending order of doc_id. ``ranks.bin`` of the same folder holds the id of every rank.

The corpus is sorted by range, encoded once into blocks of about ``BLOCK`` tokens in the shared folder, counted, and
each block becomes one file. A file is written under a name of its attempt and then moved, so a
repeated task replaces it. Only one row per file and the token counts of the vocabulary reach the driver.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.shared import batches, materialise, release, scratch_path
from trailmark.session import file_system

MAGIC = 0x31564B4F54
BLOCK = 4_000_000
STEP = 1 << 18  # ranks, a multiple of four
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
MAX_CACHED = 200_000
MAX_BYTES = 24_000_000
MARK = "\x01"
TAIL = ".,;:!?"

_SEPARATORS = "[\x1c-\x1f]"
_SEPARATOR = re.compile(_SEPARATORS)  # white space to str.split(), characters to the library
_CHUNK = re.compile(r"[^ \t\n\r\f\v]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """The library's ids of whole texts, as unsigned 16- or 32-bit integers, with a memory of text pieces.

    This vocabulary drops white space and never joins across it, so a text's ids are those of its chunks one
    after another. A chunk that is a word and punctuation is two pieces, any other is one; a batch of texts looks each
    distinct piece up once, and pieces not met before go to the library in bulk. The memory holds ``MAX_CACHED``
    pieces of ``MAX_BYTES`` at most; beyond that the half most often met stays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        (self.mark_id,) = self.library.encode(MARK, add_special_tokens=False).ids
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        tokens = self.library.get_vocab()
        self.ends_word = np.zeros(max(tokens.values()) + 1, bool)
        self.ends_word[[i for token, i in tokens.items() if token.endswith("</w>")]] = True
        self.letters: dict[str, bool] = {}  # of other than ASCII letters
        self.known = pa.array([""], pa.string())
        self.table, self.sizes, self.met = np.zeros(0, self.kind), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _stays_letter(self, c: str) -> bool:
        """Whether the library's own split leaves this letter and the word before it in one piece, apart from a full stop."""
        if c not in self.letters:
            normal = self.library.normalizer.normalize_str(f"a{c}") if self.library.normalizer else f"a{c}"
            pieces = self.library.pre_tokenizer.pre_tokenize_str(f"{normal}.")
            self.letters[c] = len(pieces) == 2 and pieces[1][0] == "."
        return self.letters[c]

    def _words(self, chunks: pa.Array) -> pa.Array:
        """Mask of what is letters to the library, and stays so in its normal form."""
        words = pc.utf8_is_alpha(chunks)
        other = chunks.filter(pc.and_(words, pc.invert(pc.string_is_ascii(chunks))))
        odd = "".join(c for c in set("".join(other.to_pylist())) if not self._stays_letter(c))
        return pc.and_(words, pc.invert(pc.match_substring_regex(chunks, f"[{odd}]"))) if odd else words

    def _of_words(self, words: list[str]) -> tuple[list, list, list]:
        """Parts of words, their ids and sizes: each word ends at the first token that ends a word."""
        parts, ids, sizes = [], [], []
        cut = [words[i : i + 500] for i in range(0, len(words), 500)]
        for part, one in zip(cut, self._encoded([" ".join(p) for p in cut])):
            found = np.asarray(one.ids, self.kind)
            ends = np.nonzero(self.ends_word[found])[0] + 1
            if len(ends) != len(part):  # letters to this library are not quite those of Arrow
                found, ends = self._alone(part)
            parts.append(part)
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return parts, ids, sizes

    def _of_chunks(self, chunks: list[str]) -> tuple[list, list, list]:
        """As for words, parted by a control character that is a token of its own; what holds it or a special token's text goes alone."""
        bulk = [c for c in chunks if MARK not in c and "<|" not in c]
        alone = [c for c in chunks if MARK in c or "<|" in c]
        parts, ids, sizes = [], [], []
        cut = [bulk[i : i + 500] for i in range(0, len(bulk), 500)]
        for part, one in zip(cut, self._encoded([f" {MARK} ".join(p) for p in cut])):
            found = np.asarray(one.ids, self.kind)
            marks = np.nonzero(found == self.mark_id)[0]
            if len(marks) != len(part) - 1:
                raise ValueError("the vocabulary joins tokens across white space")
            parts.append(part)
            ids.append(np.delete(found, marks))
            sizes.append(np.diff(np.append(marks - np.arange(len(marks)), len(found) - len(marks)), prepend=0))
        if alone:
            found, ends = self._alone(alone)
            parts.append(alone)
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return parts, ids, sizes

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [one.ids for one in self._encoded(chunks)]
        return np.array([i for one in found for i in one], self.kind), np.cumsum([len(one) for one in found])

    def _encoded(self, texts: list[str]):
        return self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of the pieces in the memory, where they are put if they are not there."""
        found = pc.index_in(pieces, value_set=self.known)
        if found.null_count:
            new = pieces.filter(pc.is_null(found)).unique()
            words = self._words(new)
            parts, ids, sizes = self._of_words(new.filter(words).to_pylist())
            more = self._of_chunks(new.filter(pc.invert(words)).to_pylist())
            parts, ids, sizes = parts + more[0], ids + more[1], sizes + more[2]
            self.known = pa.concat_arrays([self.known, *(pa.array(part, pa.string()) for part in parts)])
            self.table = np.concatenate([self.table, *ids])
            self.sizes = np.concatenate([self.sizes, *sizes])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
            found = pc.index_in(pieces, value_set=self.known)
        return np.asarray(found)

    def _forget(self) -> None:
        if len(self.known) <= MAX_CACHED and self.known.nbytes + self.table.nbytes <= MAX_BYTES:
            return
        starts = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(-self.met, kind="stable")
        size = np.cumsum(self.sizes[order] * self.table.itemsize + np.asarray(pc.binary_length(self.known))[order])
        keep = order[: max(1, min(MAX_CACHED // 2, int(np.searchsorted(size, MAX_BYTES // 2))))]
        self.table = np.concatenate([self.table[:0], *(self.table[a : a + n] for a, n in zip(starts[keep], self.sizes[keep]))])
        self.known, self.sizes, self.met = self.known.take(pa.array(keep)), self.sizes[keep], self.met[keep] // 2

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        self._forget()
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, _SEPARATORS)).as_py():
            split = [_CHUNK.findall(t) if _SEPARATOR.search(t) else t.split() for t in texts.to_pylist()]
            split = pa.array(split, pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)  # with empty chunks at the ends of a text
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary
        cores = pc.utf8_rtrim(distinct, TAIL)
        words = self._words(cores)
        tails = pc.struct_field(pc.extract_regex(distinct, f"(?P<tail>[{TAIL}]*)$"), "tail")
        cores, tails = pc.if_else(words, cores, distinct), pc.if_else(words, tails, "")
        rows = self._rows(pa.concat_arrays([cores, tails])).reshape(2, -1)
        self.met += np.bincount(rows.ravel(), minlength=len(self.met)) > 0
        starts = np.cumsum(self.sizes) - self.sizes
        index = rows[:, np.asarray(chunks.indices)].T.ravel()  # a core and its tail, chunk by chunk
        count = self.sizes[index]
        ends = np.cumsum(count)
        ids = self.table[np.repeat(starts[index] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        chunks_until = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)))])
        return ids, np.diff(np.concatenate([[0], ends])[2 * chunks_until])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.flat(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


_ENCODERS: dict[str, Encoder] = {}  # one for each vocabulary, kept by the worker from task to task


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def compress(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of uint32, ``STEP`` ranks at a time."""
    parts = [_compress(ranks[i : i + STEP]) for i in range(0, len(ranks), STEP)]
    return b"".join(control for control, _ in parts), b"".join(data for _, data in parts)


def _compress(ranks: np.ndarray) -> tuple[bytes, bytes]:
    ranks = ranks.astype(np.uint32, copy=False)
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    each = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), each[np.arange(4) < lengths[:, None]].tobytes()


# Lengths of the four codes of every control byte.
LENGTHS = np.array([[(byte >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for byte in range(256)], np.uint8)


def decompress(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks of a file, ``STEP`` at a time: what is needed beside them does not grow with the file."""
    found, at = np.empty(count, np.uint32), 0
    for start in range(0, count, STEP):
        size = min(STEP, count - start)
        part = control[start // 4 : -(-(start + size) // 4)]
        used = int(LENGTHS[part].reshape(-1)[:size].sum(dtype=np.int64))
        found[start : start + size] = _decompress(part, data[at : at + used], size)
        at += used
    return found


def _decompress(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    lengths = LENGTHS[control].reshape(-1)[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    found = data[starts].astype(np.uint32)
    for place in (1, 2, 3):
        more = np.nonzero(lengths > place)[0]
        if not len(more):
            break
        found[more] |= data[starts[more] + place].astype(np.uint32) << np.uint32(8 * place)
    return found


def _put(folder: str, name: str, parts: list[bytes]) -> str:
    system, root = file_system(folder)
    held = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(held) as out:
        for part in parts:
            out.write(part)
    system.move(held, f"{root}/{name}")
    return f"{folder}/{name}"


def _get(path: str) -> bytes:
    folder, _, name = path.rpartition("/")
    system, root = file_system(folder)
    with system.open_input_stream(f"{root}/{name}") as source:
        return source.read()


def file_parts(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    control, data = compress(ranks)
    head = np.array([MAGIC, len(doc_ids), len(ranks), len(data)], "<i8").tobytes()
    ids = np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes()
    nulls = np.array([i is None for i in doc_ids], np.uint8).tobytes()
    return [head, ids, nulls, np.asarray(counts, "<i8").tobytes(), control, data]


def read_file(raw: bytes, id_of_rank: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and the token ids of all documents of one file."""
    magic, docs, tokens, size = np.frombuffer(raw, "<i8", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = 32
    ids = np.frombuffer(raw, "<i8", docs, at)
    nulls = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(raw, "<i8", docs, at := at + docs)
    control = np.frombuffer(raw, np.uint8, -(-tokens // 4), at := at + 8 * docs)
    data = np.frombuffer(raw, np.uint8, size, at + len(control))
    ranks = decompress(control, data, tokens)
    return [None if n else i for i, n in zip(ids.tolist(), nulls.tolist())], counts, id_of_rank[ranks]


def _blocks(docs: DataFrame, path: str, end_id: int, block: int) -> DataFrame:
    """Sorted, encoded blocks: part, number, doc_ids, counts, ids (bytes), wide."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, number = TaskContext.get().partitionId(), encoder_of(path), 0
        ids: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def result() -> pa.RecordBatch:
            names = ["part", "number", "doc_ids", "counts", "ids", "wide"]
            values = [[part], [number], [ids], [counts], [np.concatenate(held).tobytes()], [encoder.kind is np.uint32]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

        for batch in batches(source, chars=2_000_000):
            found, each = encoder.flat(batch.column("text"))
            ended = np.insert(found, np.cumsum(each), np.array(end_id, encoder.kind))
            ends, doc_ids, done = np.cumsum(each + 1), batch.column("doc_id").to_pylist(), 0
            while done < len(doc_ids):
                before = int(ends[done - 1]) if done else 0
                stop = min(len(doc_ids), int(np.searchsorted(ends, before + block - size)) + 1)  # a block ends with the row that fills it
                ids += doc_ids[done:stop]
                counts += (each[done:stop] + 1).tolist()
                held.append(ended[before : ends[stop - 1]])
                size += int(ends[stop - 1]) - before
                done = stop
                if size >= block:
                    yield result()
                    ids, counts, held, size, number = [], [], [], 0, number + 1
        if ids:
            yield result()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "row"]  # the last two split repeated ids
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return ranged.mapInArrow(run, "part int, number int, doc_ids array<bigint>, counts array<bigint>, ids binary, wide boolean")


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if wide else np.uint16)


def _ranking(blocks: DataFrame) -> np.ndarray:
    """Ids by falling corpus count, then by id; at most one entry for each id of the vocabulary."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in source:
            for raw, wide in zip(batch.column("ids"), batch.column("wide")):
                found = np.bincount(_ids(raw.as_py(), wide.as_py()), minlength=len(total))
                found[: len(total)] += total
                total = found
        met = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["id", "n"])

    counted = blocks.select("ids", "wide").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(counted.collect(), key=lambda r: (-r.n, r.id))
    return np.array([r.id for r in rows], "<u4")


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Write the token files of all whole texts into ``folder``; one row per file: path, start, n_docs, n_tokens.

    A null text is empty and gives the end id alone; null ids come first; repeated ids stay apart, ordered
    by a hash of their text; other columns are left out. An empty table gives no file.
    """
    spark = docs.sparkSession
    blocks = materialise(_blocks(docs, path or tokenizer_path(), end_id, block), "token_blocks")
    id_of_rank = _ranking(blocks)
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    _put(folder, "ranks.bin", [id_of_rank.tobytes()])
    rank_of = np.zeros(int(id_of_rank.max()) + 1 if len(id_of_rank) else 1, np.uint32)
    rank_of[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)  # 4 bytes for each id of the vocabulary

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "ids"):
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ranks = sent.value[_ids(one["ids"], one["wide"])]
                name = f"tokens-{one['part']:06d}-{one['number']:06d}.bin"
                written = _put(folder, name, file_parts(one["doc_ids"], np.array(one["counts"]), ranks))
                values = [one["part"], one["number"], written, len(one["doc_ids"]), len(ranks)]
                types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["part", "number", "path", "n_docs", "n_tokens"])

    files = materialise(blocks.mapInArrow(run, "part int, number int, path string, n_docs bigint, n_tokens bigint"), "token_files")
    start, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: (r.part, r.number)):  # one row per file
        rows.append((r.path, start, r.n_docs, r.n_tokens))
        start += r.n_tokens
    return spark.createDataFrame(rows, "path string, start bigint, n_docs bigint, n_tokens bigint")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files that :func:`write_tokens` lists."""
    return _read(files, "ids array<bigint>", lambda ids: ids.tolist(), pa.list_(pa.int64()))


def token_digests(files: DataFrame) -> DataFrame:
    """As :func:`read_tokens` with ``ids_crc32``, of the ids as little-endian 32-bit integers, in place of the ids."""
    return _read(files, "ids_crc32 bigint", lambda ids: crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(files: DataFrame, field: str, make, kind: pa.DataType) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in source:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                folder = path.rpartition("/")[0]
                if folder not in tables:
                    tables[folder] = np.frombuffer(_get(f"{folder}/ranks.bin"), "<u4")
                doc_ids, counts, ids = read_file(_get(path), tables[folder])
                ends = np.cumsum(counts)
                for begin in range(0, len(doc_ids), 1000):
                    span = range(begin, min(begin + 1000, len(doc_ids)))
                    made = [make(ids[ends[i] - counts[i] : ends[i]]) for i in span]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_ids[i] for i in span], pa.int64()), pa.array(start + ends[span.start : span.stop] - counts[span.start : span.stop], pa.int64()),
                         pa.array(counts[span.start : span.stop]), pa.array(made, kind)],
                        names=["doc_id", "start", "n_tokens", field.split()[0]],
                    )
                del counts, ids, ends
        release()

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts).select("path", "start").mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {field}")


def token_file_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write ``docs`` to token files below the shared folder and digest what is read back from them."""
    return token_digests(write_tokens(docs, scratch_path(spark, "tokens")))
