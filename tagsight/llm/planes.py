"""Token ids in files: blocks of ids as bit or byte planes, each compressed, with a chunk index."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsight.plans.lineage import collect_small, small_table

from .tokens import BULK, encoder, text_slices

#: ids of a block
BLOCK = 65_536
CHUNKS = (
    "part int, chunk int, part_start long, n_ids int, kind string, crc32 long, first_doc long, doc_ids array<long>, "
    "counts array<int>, planes array<binary>"
)


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 1) -> list[bytes]:
    """Planes of unsigned 32-bit ids, least significant first: 4 byte planes or 32 bit planes, each zstandard-compressed."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level).compress
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [squeeze(np.ascontiguousarray(by_byte[:, b]).tobytes()) for b in range(4)]
    if kind == "bit":
        return [squeeze(np.packbits((by_byte[:, b // 8] >> (b % 8)) & 1).tobytes()) for b in range(32)]
    raise ValueError(f"unknown kind of plane: {kind}")


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    out = np.zeros((n, 4), np.uint8)
    for b, plane in enumerate(planes):
        data = np.frombuffer(open_(plane), np.uint8)
        if kind == "byte":
            out[:, b] = data
        else:
            out[:, b // 8] |= np.unpackbits(data, count=n) << (b % 8)
    return out.reshape(-1).view("<u4")


def _write_blocks(path: str, spaced: bool, end: bytes, kind: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("part", pa.int32()), ("chunk", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()),
            ("crc32", pa.int64()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
            ("planes", pa.list_(pa.binary())),
        ])
        codes, part = encoder(path, spaced), TaskContext.get().partitionId()
        chunk = start = doc = 0
        held = bytearray()
        docs: list = []
        counts: list[int] = []

        def emit(size: int) -> pa.RecordBatch:
            nonlocal chunk, start, doc
            raw, left, n = bytes(held[: 4 * size]), size, 0
            del held[: 4 * size]
            taken: list[int] = []
            while n < len(counts) and (left or not counts[n]):
                taken.append(min(left, counts[n]))
                left -= taken[-1]
                counts[n] -= taken[-1]
                n += 1
            row = [part, chunk, start, size, kind, zlib.crc32(raw), doc, docs[:n], taken, to_planes(np.frombuffer(raw, "<u4"), kind)]
            open_end = n > 0 and counts[n - 1] > 0  # the last document goes on in the next block
            done = n - open_end
            del docs[:done], counts[:done]
            chunk, start, doc = chunk + 1, start + size, doc + done
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema, strict=True)], schema=schema)

        for batch in text_slices(batches, "text", BULK):
            for doc_id, ids in zip(batch.column("id").to_pylist(), codes.encode(batch.column("text")), strict=True):
                held += ids + end
                docs.append(doc_id)
                counts.append((len(ids) + len(end)) // 4)
                while len(held) >= 4 * block:
                    yield emit(block)
        if counts:
            yield emit(len(held) // 4)

    return run


def write_token_files(
    docs: DataFrame, out: str, tokenizer: str, spaced: bool = True, end_id: int | None = 2, id_col: str = "doc_id",
    text_col: str = "text", kind: str = "byte", block: int = BLOCK,
) -> None:
    """Encode every whole text and store the ids under `out`, in ascending id order.

    `out/chunks` holds one row per block: its planes and the documents in it; `out/index` one row per block with its
    place (part, chunk, first id of all, number of ids, bytes of each plane) and checksum. Parts follow one another in
    id order, and so do chunks within a part. A part is one sorted range of ids, so each task holds one block of ids
    and one slice of texts at a time.

    NULL texts are empty and keep only the end id; NULL ids come first; equal ids are ordered by text. Other columns
    are not read. An empty table gives two empty folders.
    """
    spark = docs.sparkSession
    end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    blocks = rows.mapInArrow(_write_blocks(tokenizer, spaced, end, kind, block), CHUNKS)
    blocks.write.option("compression", "none").parquet(f"{out}/chunks")
    stored = spark.read.schema(CHUNKS).parquet(f"{out}/chunks")
    totals = collect_small(stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part"))
    before, at = [], 0
    for r in totals:
        before.append((r["part"], at))
        at += r["n"]
    index = stored.join(small_table(spark, before, "part int, before long"), "part").select(
        "part", "chunk", (F.col("before") + F.col("part_start")).alias("first_id"), "n_ids", "kind", "crc32",
        F.size("doc_ids").alias("n_docs"), F.transform("planes", F.length).alias("plane_bytes"),
    )
    index.write.parquet(f"{out}/index")


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = from_planes(row["planes"], row["n_ids"], row["kind"]).tobytes()
            if zlib.crc32(raw) != row["crc32"]:
                raise ValueError(f"damaged block {row['part']}/{row['chunk']}")
            view, at, crcs, starts = memoryview(raw), 0, [], []
            for n in row["counts"]:
                crcs.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                starts.append(row["part_start"] + at)
                at += n
            m = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * m, pa.int32()), pa.array(range(row["first_doc"], row["first_doc"] + m), pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64()),
                ],
                names=["part", "place", "doc_id", "at", "n", "crc"],
            )


def crc32_joined(pieces: list[tuple[int, int]]) -> int:
    """crc32 of joined byte strings from (crc32, length) of each: shifting by zeros is a linear map over single bits."""

    def times(mat: list[int], vec: int) -> int:
        out = i = 0
        while vec:
            if vec & 1:
                out ^= mat[i]
            vec >>= 1
            i += 1
        return out

    total = 0
    for crc, n in pieces:
        mat = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
        for _ in range(3):
            mat = [times(mat, m) for m in mat]  # one zero byte
        while n:
            if n & 1:
                total = times(mat, total)
            mat = [times(mat, m) for m in mat]
            n >>= 1
        total ^= crc
    return total


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    index = spark.read.parquet(f"{out}/index")
    before = collect_small(index.groupBy("part").agg(F.min("first_id").alias("before")))
    pieces = spark.read.schema(CHUNKS).parquet(f"{out}/chunks").mapInArrow(
        _read_blocks, "part int, place long, doc_id long, at long, n long, crc long"
    )

    @F.arrow_udf("long")
    def joined(parts: pa.Array) -> pa.Array:
        held = parts.flatten()
        crcs, sizes = held.field("crc").to_numpy(), held.field("n").to_numpy()
        counts = pc.list_value_length(parts).to_numpy()
        begins = np.cumsum(counts) - counts
        out = crcs[begins]
        for i in np.flatnonzero(counts > 1).tolist():
            own = slice(begins[i], begins[i] + counts[i])
            out[i] = crc32_joined(list(zip(crcs[own].tolist(), (4 * sizes[own]).tolist(), strict=True)))
        return pa.array(out, pa.int64())

    docs = pieces.groupBy("part", "place").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"),
    )
    bases = small_table(spark, [(r["part"], r["before"]) for r in before], "part int, before long")
    return docs.join(bases, "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", joined("pieces").alias("ids_crc32")
    )
