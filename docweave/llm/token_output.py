"""Token-ID output (operator 5): documents' ids, each compressed apart with a shared dictionary."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = "part int, block int, tokens_before bigint, n_tokens bigint, first_id bigint, last_id bigint, dict_hash string, width int, doc_ids binary, null_ids binary, offsets binary, lengths binary, payload binary"
_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32())]
    + [(n, pa.int64()) for n in ("tokens_before", "n_tokens", "first_id", "last_id")]
    + [("dict_hash", pa.string()), ("width", pa.int32())]
    + [(n, pa.binary()) for n in ("doc_ids", "null_ids", "offsets", "lengths", "payload")]
)


_NO_ID = -1e19  # below every id


def _narrow(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, "<u4").astype("<u2").tobytes() if width == 2 else raw


def _slice(raw: bytes, most: int, width: int, doc_id: int | None) -> bytes:
    room = (len(raw) - most) // width
    at = zlib.crc32(str(doc_id).encode()) % (room + 1) * width if room > 0 else 0
    return raw[at : at + most]


def train_dictionary(docs: DataFrame, *, vocabulary: str, width: int, documents: int = 3000, most: int = 1 << 15, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary from the serialized ids of about ``documents`` rows. Of an array longer than
    ``most`` bytes it takes a slice, from a place that the id's hash gives (both bounds only limit
    what it is trained on). Empty if there is too little."""
    import zstandard

    sample = common.sampled(docs.select("doc_id", "text"), F.col("doc_id"), documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).many
        for ids, texts in common.rows(batches, "doc_id", "text"):
            made = [_slice(_narrow(raw + tokens.END, width), most, width, i) for i, raw in zip(ids, encode([t or "" for t in texts]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "ids"])

    rows = common.arrow_map(sample, run, "doc_id bigint, ids binary").collect()
    samples = [bytes(r.ids) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.ids))]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, *, vocabulary: str | None = None, parts: int | None = None, block_bytes: int = 1 << 22, level: int = 3) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text) in ascending order of doc_id to ``path``.

    The format is a Parquet table, so it needs no other file system than Spark's, and task commits
    make it safe against lost executors. A row is a block of about ``block_bytes``: documents'
    ids, offsets and lengths, and one zstandard frame a document, all with the shared dictionary,
    which stands in ``path``/dictionary under its SHA-256. ``tokens_before`` counts the part's ids
    before the block. A document's ids are those of its text and then id 0; null texts are empty,
    null ids come first, equal ids in the order of their frames' checksums, spread over parts if they
    are many; an empty table gives no block. A text of any length is one frame.
    """
    import zstandard

    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_vocabulary()
    width = 2 if tokens.encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(docs, vocabulary=vocabulary, width=width)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, width, bytearray(dictionary))], "dict_hash string, width int, dictionary binary").write.parquet(f"{path}/dictionary")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("double"), F.lit(_NO_ID)).alias("d"))
    bounds = np.array(sorted(ids.approxQuantile("d", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else [])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = tokens.encoder(vocabulary).many
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sum", pa.int64()), ("frame", pa.binary())])
        for ids, texts in common.rows(batches, "doc_id", "text"):
            raw = [r + tokens.END for r in many([t or "" for t in texts])]
            frames = [pack.compress(_narrow(r, width)) for r in raw]
            sums = [zlib.crc32(f) for f in frames]
            yield common.batch(schema, [_parts(bounds, ids, sums), ids, [len(r) // 4 for r in raw], sums, frames])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, bytes]] = []
        now, block, before, size = None, 0, 0, 0

        def dump() -> pa.RecordBatch:
            nonlocal block, before, size
            ids, lengths = [h[0] for h in held], np.array([h[1] for h in held], "<u8")
            offsets = np.concatenate(([0], np.cumsum([len(h[2]) for h in held]))).astype("<u8")
            numbers, total = [i for i in ids if i is not None], int(lengths.sum())
            row = [now, block, before, total, min(numbers, default=None), max(numbers, default=None), name, width, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "u1").tobytes(), offsets.tobytes(), lengths.tobytes(), b"".join(h[2] for h in held)]
            block, before, size = block + 1, before + total, 0
            held.clear()
            return common.batch(_BLOCK, [[x] for x in row])

        for ps, ids, ns, frames in common.rows(batches, "part", "doc_id", "n", "frame"):  # as sorted
            for p, i, n, frame in zip(ps, ids, ns, frames, strict=True):
                if held and (p != now or size >= block_bytes):
                    yield dump()
                if p != now:
                    now, block, before = p, 0, 0
                held.append((i, n, frame))
                size += len(frame)
        if held:
            yield dump()

    encoded = common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "part int, doc_id bigint, n bigint, sum bigint, frame binary")
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "sum", "frame")
    common.arrow_map(dealt.select("part", "doc_id", "n", "frame"), lay, BLOCK).write.parquet(f"{path}/blocks")


def _parts(bounds: np.ndarray, ids: list[int | None], sums: list[int]) -> list[int]:
    """Part of each document by its id. An id that is a bound may stand on either side of it, and one
    that is several bounds in all parts between them: there the checksum decides, so an id of many
    rows doesn't fill one part."""
    x = np.array([_NO_ID if i is None else float(i) for i in ids])
    low, high = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
    exact = np.array([i is None or abs(i) < 1 << 53 for i in ids], bool)  # else other ids are equal as doubles
    spread = low + (high - low + 1) * np.array(sums, np.int64) // (1 << 32)
    return np.where(exact, spread, high).tolist()


def _decoder(dictionaries: dict[str, bytes]):
    import zstandard

    made: dict[str, zstandard.ZstdDecompressor] = {}

    def frames(row: dict) -> Iterator[tuple[int | None, bytes]]:
        name = row["dict_hash"]
        if name not in made:
            raw = dictionaries[name]
            if hashlib.sha256(raw).hexdigest() != name:
                raise ValueError(f"dictionary {name} is damaged")
            made[name] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        ids, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["null_ids"], "u1")
        offsets, payload = np.frombuffer(row["offsets"], "<u8").tolist(), row["payload"]
        for i, none, a, b in zip(ids.tolist(), nulls.tolist(), offsets, offsets[1:], strict=False):
            raw = made[name].decompress(payload[a:b])
            yield None if none else i, np.frombuffer(raw, f"<u{row['width']}").astype("<u4").tobytes()

    return frames


def _dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    return {r.dict_hash: bytes(r.dictionary) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    shared = spark.sparkContext.broadcast(_dictionaries(spark, path))
    blocks = spark.read.parquet(f"{path}/blocks")
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _decoder(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                row, out = b.slice(i, 1).to_pylist()[0], []
                at, lengths = row["tokens_before"], np.frombuffer(row["lengths"], "<u8").tolist()
                for (doc_id, ids), n in zip(frames(row), lengths, strict=True):
                    if len(ids) != 4 * n:
                        raise ValueError(f"document {doc_id} has {len(ids) // 4} ids, not {n}")
                    out.append((row["part"], doc_id, at, n, ids))
                    at += n
                    if len(out) >= 512:
                        yield common.batch(schema, [list(c) for c in zip(*out, strict=True)])
                        out.clear()
                if out:
                    yield common.batch(schema, [list(c) for c in zip(*out, strict=True)])

    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = [], 0
    for p, n in sums:  # one number for each part of the table
        starts.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, before bigint"))
    rows = common.arrow_map(blocks, run, "part int, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    return rows.join(offsets, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id: reads the blocks whose range holds it and decodes only
    their frames, by the offset index."""
    frames = _decoder(_dictionaries(spark, path))
    out = []
    for r in spark.read.parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "block").collect():
        row = r.asDict()
        hits = np.flatnonzero((np.frombuffer(row["doc_ids"], "<i8") == doc_id) & (np.frombuffer(row["null_ids"], "u1") == 0))
        offsets = np.frombuffer(row["offsets"], "<u8")
        for h in hits.tolist():
            one = row | {"doc_ids": row["doc_ids"][8 * h : 8 * h + 8], "null_ids": b"\0", "offsets": offsets[h : h + 2].tobytes()}
            out += [np.frombuffer(ids, "<u4") for _, ids in frames(one)]
    return out
