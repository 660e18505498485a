"""Token-ID output as a content-addressed store.

Every text is encoded, an end id is appended, and a rolling hash over the ids
cuts the stream of each document into chunks, so equal passages give equal
chunks wherever they stand. A chunk is named by the digest of its ids and kept
once, by the first document (in ascending doc_id order) that has it; the others
refer to it. The store is a Parquet table of documents in ascending doc_id
order, one file a range. A row holds

* the recipe: digests and lengths of the document's chunks, in order,
* ``owned``: which of them it keeps, ``given``: which of those others refer to,
* ``payload``: the kept ids, little-endian unsigned integers of 16 bits, or 32
  where the vocabulary needs them, zstd-compressed with the manifest's dictionary,
* ``root``: the Merkle root over the recipe's digests,
* ``part``, ``at``, ``local_start``: its range, its place there, ids before it there.

The manifest has one row a range: documents, ids, and the Merkle root over the
documents' roots; its first row also has the dictionary, trained on at most
``SAMPLE`` documents, which changes sizes alone. ``read`` puts each document together from its recipe and
fails if a digest, a root or the manifest doesn't agree.

Which chunks are shared is found without moving most of them: an aggregate over
half of every digest tells which may be repeated, and only what passes a Bloom
filter of those shuffles again, by its whole digest, so texts that share nothing
move once, to their range.

Null texts count as empty: such a document has the end id alone. Rows that
repeat a doc_id are stored one after the other; null ids come first. An empty
table gives an empty store. Only the id and text columns are read. A document is a
row of the store: one whose packed ids or digests pass the 2 GB that Spark has
for a value fails the write, shorter ones of any length go through.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions.pieces import STOPS
from stratum.llm import bloom
from stratum.llm._common import map_batches, shared_dir, sliced, slices, stage
from stratum.llm.bpe import load, pieces

#: Rolling hash: ids it looks back over; a cut on average every 2 ** BITS ids, and the least and most ids of a chunk.
WINDOW, BITS, LEAST, MOST = 8, 5, 16, 256
END_ID = 1
#: Digests that a node of a Merkle tree takes.
FAN = 16
#: Bounds of what the dictionary is trained on: documents, and characters of each; and its bytes.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 1000, 20_000, 65_536
#: Rows and bytes of texts encoded at a time; the more, the fewer words are looked up twice.
SLICE = 2048, 4 << 20
#: Words a worker remembers.
REMEMBERED = 1_200_000


@dataclass(frozen=True)
class Store:
    documents: str
    manifest: str


def separates(tokenizer) -> bool:
    """Whether ASCII white space only separates words: it gives no ids and changes none of its neighbours'."""
    probe = "ab c'd 12 éx's .."
    whole = tokenizer.encode(probe.replace(" ", " \t\n\r\x0b\x0c "), add_special_tokens=False).ids
    return whole == [i for w in probe.split(" ") for i in tokenizer.encode(w, add_special_tokens=False).ids]


_fresh = {kind: hashlib.blake2b(digest_size=16, person=kind) for kind in (b"chunk", b"node", b"root")}


def digest(data: bytes, kind: bytes = b"chunk") -> bytes:
    """128 bits; chunks, inner nodes and roots are hashed apart."""
    h = _fresh[kind].copy()
    h.update(data)
    return h.digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the tree over digests and their number, FAN to a node; no leaves give the digest of nothing."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + FAN]), b"node") for i in range(0, len(level), FAN)]
    return digest(len(leaves).to_bytes(8, "little") + level[0], b"root")


def rolling(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each place, a hash of the last WINDOW ids."""
    g = gear[ids]
    h = g.copy()
    for k in range(1, min(WINDOW, len(g))):
        h[k:] += g[:-k] << np.uint64(k)
    return h


def cuts(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Places after an id whose rolling hash has BITS zero bits on top. Documents may stand one after the other: LEAST is over WINDOW, so none sees its neighbour."""
    return np.flatnonzero(rolling(ids, gear) >> np.uint64(64 - BITS) == 0) + 1


def chunk_ends(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids that may be cut at ``places``, LEAST and MOST ids kept to."""
    out, at = [], 0
    for cut in places:
        while cut - at > MOST:
            at += MOST
            out.append(at)
        if cut - at >= LEAST and n - cut >= LEAST:
            out.append(cut)
            at = cut
    while n - at > MOST:
        at += MOST
        out.append(at)
    if n > at:
        out.append(n)
    return out


def _kind(tokenizer) -> str:
    return "<u2" if max(tokenizer.get_vocab_size(with_added_tokens=True), END_ID + 1) <= 1 << 16 else "<u4"


def binary(data, offsets: np.ndarray) -> pa.Array:
    """What lies in ``data`` between each offset and the next, as a column."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def between(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """The same as a list."""
    at = offsets.tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


def list_ends(lists: pa.Array) -> np.ndarray:
    """0, and up to each list's end the number of values; null counts as empty."""
    return np.r_[0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())].astype(np.int64)


def before_stops(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places between a word's last Latin letter and the stops that end it, which are a piece of their own."""
    starts, ends = offsets[:-1], offsets[1:]
    heads = pc.binary_length(pc.ascii_rtrim(pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), STOPS.decode())).to_numpy()
    at = (starts + heads)[(heads > 0) & (starts + heads < ends)]
    last, wide = data[at - 1], data[np.maximum(at, 2) - 2] == 0xC3
    return at[_LETTER[last] | wide & _LATIN[last]]


#: By byte: ASCII letters, and the second bytes of the letters from U+00C0 to U+00FF.
_LETTER = np.array([bytes([b]).isalpha() for b in range(256)])
_LATIN = np.array([0x80 <= b < 0xC0 and bytes([0xC3, b]).decode().isalpha() for b in range(256)])


def encoder(path: str):
    """A function from texts to all their ids in order, and how many each has; ``end``, if given, follows every text.

    A word is looked up once a call, and the words of a worker are remembered.
    """
    kind = np.dtype(_kind(load(path)))
    known = pieces(path, kind.str, REMEMBERED)
    tokenizer, get = known.tokenizer, known.__getitem__
    whole = not separates(tokenizer)
    folds = tokenizer.normalizer is not None and tokenizer.encode("AB C", add_special_tokens=False).ids == tokenizer.encode("ab c", add_special_tokens=False).ids

    def words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Packed ids of the distinct pieces, the pieces of all texts by their place there, and the number of pieces up to each text's end."""
        if whole:
            return [np.asarray(tokenizer.encode(s, add_special_tokens=False).ids, kind).tobytes() for s in texts.to_pylist()], np.arange(len(texts)), np.arange(len(texts)) + 1
        if folds:  # fewer kinds of word; special tokens are told by their case
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        ends, flat = split.offsets.to_numpy()[1:] - split.offsets[0].as_py(), split.flatten()
        if not len(flat):
            return [], np.zeros(0, np.int64), ends
        _, offsets, data = flat.buffers()
        offsets, data = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1], np.frombuffer(data or b"", np.uint8)
        if known.direct:
            cut = before_stops(data, offsets)
            ends, offsets = ends + np.searchsorted(cut, offsets[ends]), np.insert(offsets, np.searchsorted(offsets, cut), cut)
        coded = binary(data, offsets).dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()
        return list(map(get, between(data.to_pybytes() if data else b"", np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1]))), coded.indices.to_numpy(), ends

    def ids(texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        distinct, codes, ends = words(pc.fill_null(texts, "").cast(pa.string()))
        if end is not None:
            codes, ends = np.insert(codes, ends, len(distinct)), ends + np.arange(1, len(ends) + 1)
            distinct.append(np.asarray([end], kind).tobytes())
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // kind.itemsize
        n = sizes[codes]
        till, starts = np.cumsum(n), np.cumsum(sizes) - sizes
        small = np.int32 if max(starts[-1:].max(initial=0), till[-1:].max(initial=0)) < 1 << 30 else np.int64
        # where a piece's ids lie among those of the distinct ones, less where they go
        at = np.repeat((starts[codes] - till + n).astype(small), n)
        at += np.arange(len(at), dtype=small)
        return np.frombuffer(b"".join(distinct), kind)[at], np.diff(np.r_[0, till][ends], prepend=0)

    return ids


def zstd(dictionary: bytes):
    """Compression and decompression with a dictionary, or without where it is empty."""
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=data).compress, zstandard.ZstdDecompressor(dict_data=data).decompress


def dictionary(docs: DataFrame, path: str) -> bytes:
    """Trained by one task on a bounded sample of the documents; empty where that is too small."""

    def run(batches):
        import zstandard

        encode, held = encoder(path), []
        for batch in sliced(batches):
            ids, n = encode(batch.column(0))
            held += between(ids.tobytes(), np.r_[0, np.cumsum(n)] * ids.itemsize)
        try:
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.train_dictionary(DICTIONARY, held).as_bytes()], pa.binary())], names=["d"])
        except zstandard.ZstdError:  # too few or too short
            return

    # take() reads as few partitions as it needs; what it brings is bounded by SAMPLE and SAMPLE_CHARS
    held = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("text").take(SAMPLE)
    row = docs.sparkSession.createDataFrame(held, "text string").coalesce(1).mapInArrow(run, "d binary").first()
    return bytes(row["d"]) if row else b""


def encoded(docs: DataFrame, path: str, end_id: int = END_ID, words: bytes = b"") -> DataFrame:
    """doc_id, n_tokens, packed lengths and digests of the chunks, Merkle root and the compressed ids of every row; ``words`` is the dictionary."""

    def make():
        tokenizer = load(path)
        kind, encode = _kind(tokenizer), encoder(path)
        gear = np.random.default_rng(1).integers(0, 1 << 64, 1 << 16 if kind == "<u2" else max(tokenizer.get_vocab_size(), end_id + 1), np.uint64)
        pack, width = zstd(words)[0], np.dtype(kind).itemsize

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, n = encode(batch.column(1), end_id)
            starts = np.r_[0, np.cumsum(n)]
            found, data = cuts(ids, gear), between(ids.tobytes(), starts * width)
            sides = np.searchsorted(found, starts, "right")
            every, digests, roots = [], [], []
            for x, at, size, lo, hi in zip(data, starts.tolist(), n.tolist(), sides.tolist(), sides[1:].tolist()):
                ends = chunk_ends((found[lo:hi] - at).tolist(), size)
                own = [digest(x[a * width : b * width]) for a, b in zip([0, *ends], ends)]
                every.append(ends)
                digests.append(b"".join(own))
                roots.append(merkle(own))
            till = np.r_[0, np.cumsum([len(ends) for ends in every])].astype(np.int64)
            at = np.fromiter(chain.from_iterable(every), np.int64, till[-1]) + np.repeat(starts[:-1], np.diff(till))
            lengths = between(np.diff(at, prepend=0).astype("<u2").tobytes(), 2 * till)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(x, pa.binary()) for x in (lengths, digests, roots, [pack(x) for x in data]))], names=["doc_id", "n_tokens", "lengths", "hashes", "root", "payload"])

        return run

    def every(batches):
        run = make()
        for batch in batches:
            for part in slices(batch, *SLICE):
                yield run(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(every, "doc_id bigint, n_tokens bigint, lengths binary, hashes binary, root binary, payload binary")


def _halves(digests: list[bytes]) -> np.ndarray:
    """n x 2 longs of packed digests."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """doc_id, row_id, seq, a, b (the digest's halves) of the chunks that may be repeated: all whose digest occurs more than once, and few others."""

    def every(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_halves(batch.column(0).to_pylist())[:, 0])], names=["a"])

    repeated = stage(rows.select("hashes").mapInArrow(every, "a bigint").groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"))
    bits = bloom.size(repeated.count())
    shared = rows.sparkSession.sparkContext.broadcast(bloom.maps(repeated, bits)[0])

    def some(batches):
        for batch in batches:
            digests = batch.column(2).to_pylist()
            x, n = _halves(digests), np.array([len(d) // 16 for d in digests], np.int64)
            hit = np.flatnonzero(bloom.has(shared.value, x[:, 0], bits))
            row = np.repeat(np.arange(len(n)), n)[hit]
            seq = hit - np.r_[0, np.cumsum(n)][row] if len(n) else hit
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in (0, 1)), pa.array(seq.astype(np.int32)), pa.array(x[hit, 0]), pa.array(x[hit, 1])], names=["doc_id", "row_id", "seq", "a", "b"])

    return rows.select("doc_id", "row_id", "hashes").mapInArrow(some, "doc_id bigint, row_id bigint, seq int, a bigint, b bigint")


def write(docs: DataFrame, path: str, end_id: int = END_ID) -> Store:
    """Writes the store of all rows of ``docs`` below the shared folder."""
    spark = docs.sparkSession
    kind = _kind(load(path))
    width = np.dtype(kind).itemsize
    words = dictionary(docs, path)
    rows = stage(encoded(docs, path, end_id, words).withColumn("row_id", F.monotonically_increasing_id()))
    refs = repeated_chunks(rows)
    # as a table, so that the join below is of two plain exchanges, of which Spark can split a hot chunk's
    first = stage(refs.groupBy("a", "b").agg(F.min(F.struct("doc_id", "row_id", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first.row_id", "first.seq"))
    shared = refs.join(first.select("a", "b", F.col("row_id").alias("first_row"), F.col("seq").alias("first_seq")), ["a", "b"]).withColumn("owner", (F.col("row_id") == F.col("first_row")) & (F.col("seq") == F.col("first_seq")))
    marks = stage(shared.groupBy("doc_id", "row_id").agg(F.collect_list(F.when(F.col("owner"), F.col("seq"))).alias("given"), F.collect_list(F.when(~F.col("owner"), F.col("seq"))).alias("foreign")))
    # digests follow from the ids, so they don't move along
    both = rows.drop("hashes").withColumn("kind", F.lit(1)).unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    laid = both.repartitionByRange(F.col("doc_id").asc_nulls_first(), "row_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_id", "kind")

    def lay(batches):
        from pyspark import TaskContext

        pack, unpack = zstd(words)
        part, at, start, mark = TaskContext.get().partitionId(), 0, 0, None
        for batch in sliced(batches):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sorts, marks = col["kind"].to_pylist(), {}
            seqs = {n: (list_ends(col[n]), col[n].flatten().to_numpy()) for n in ("given", "foreign")}
            rows = []
            for i, sort in enumerate(sorts):
                if sort == 0:
                    mark = [x[e[i] : e[i + 1]] for e, x in seqs.values()]
                    continue
                if mark:
                    marks[len(rows)] = mark
                rows.append(i)
                mark = None
            kept = {n: c.take(pa.array(rows, pa.int32())) for n, c in col.items()}
            sizes = [np.frombuffer(x, "<u2") for x in kept["lengths"].to_pylist()]
            n_chunks = np.array([len(x) for x in sizes], np.int64)
            ends = np.r_[0, np.cumsum(n_chunks)]
            owned, given = np.ones(ends[-1], bool), np.zeros(ends[-1], bool)
            payload, hashes = kept["payload"].to_pylist(), []
            places = np.r_[0, np.cumsum(np.concatenate([*sizes, np.zeros(0, "<u2")]), dtype=np.int64)] * width
            for i, x in enumerate(payload):
                lo, hi = int(ends[i]), int(ends[i + 1])
                chunks = between(unpack(x), places[lo : hi + 1] - places[lo])
                hashes += map(digest, chunks)
                if i not in marks:
                    continue
                out, foreign = marks[i]
                given[lo + out] = True
                if len(foreign):
                    owned[lo + foreign] = False
                    payload[i] = pack(b"".join(chunks[k] for k in np.flatnonzero(owned[lo:hi]).tolist()))
            starts = start + np.r_[0, np.cumsum(kept["n_tokens"].to_numpy(zero_copy_only=False))].astype(np.int64)
            offsets = pa.array(ends, pa.int32())
            digests = binary(b"".join(hashes), np.arange(0, 16 * ends[-1] + 1, 16))
            new = {"lengths": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*sizes, np.zeros(0, "<u2")]).astype(np.int32))), "hashes": pa.ListArray.from_arrays(offsets, digests), "owned": pa.ListArray.from_arrays(offsets, pa.array(owned)), "given": pa.ListArray.from_arrays(offsets, pa.array(given)), "payload": pa.array(payload, pa.binary()), "part": pa.array(np.full(len(rows), part), pa.int32()), "at": pa.array(at + np.arange(len(rows)), pa.int64()), "local_start": pa.array(starts[:-1], pa.int64())}
            at, start = at + len(rows), int(starts[-1])
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else kept[f.name] for f in laid_schema], names=laid_schema.names)

    laid_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("lengths", pa.list_(pa.int32())), ("hashes", pa.list_(pa.binary())), ("owned", pa.list_(pa.bool_())), ("given", pa.list_(pa.bool_())), ("payload", pa.binary()), ("root", pa.binary()), ("part", pa.int32()), ("at", pa.int64()), ("local_start", pa.int64())])
    top = shared_dir(spark)
    store = Store(f"{top}/documents", f"{top}/manifest")
    laid.mapInArrow(lay, "doc_id bigint, n_tokens bigint, lengths array<int>, hashes array<binary>, owned array<boolean>, given array<boolean>, payload binary, root binary, part int, at bigint, local_start bigint").write.option("compression", "zstd").parquet(store.documents)
    manifest = _manifest(spark.read.parquet(store.documents))
    manifest.withColumn("dictionary", F.when(F.col("part") == F.min("part").over(Window.partitionBy()), F.lit(bytearray(words)))).write.parquet(store.manifest)
    return store


def _manifest(rows: DataFrame) -> DataFrame:
    """One row a range: its documents, its ids, and the Merkle root over blocks of the documents' roots."""
    block = F.expr("at div 4096")
    blocks = rows.groupBy("part", block.alias("block")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda x: F.hex(x["root"]))), 256).alias("root"))
    return blocks.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "root"))), lambda x: x["root"])), 256).alias("root"))


def read(spark: SparkSession, store: Store, path: str, ids: bool = True) -> DataFrame:
    """Per document, put together from the store and verified: doc_id, start, n_tokens, n_chunks, n_owned, ids_crc32, and with ``ids`` the ids, packed as stored.

    The checksum is over the ids as little-endian unsigned 32-bit integers.
    """
    rows = spark.read.parquet(store.documents)
    kind = _kind(load(path))
    width = np.dtype(kind).itemsize
    written = spark.read.parquet(store.manifest)
    # a range that only one side has is wrong too
    same = F.lit(True)
    for c in ("n_docs", "n_tokens", "root"):
        same &= F.col(f"found.{c}").eqNullSafe(F.col(f"said.{c}"))
    words = written.where("dictionary is not null").first()
    words = bytes(words["dictionary"]) if words else b""
    if not _manifest(rows).alias("found").join(written.alias("said"), "part", "full").where(~same).isEmpty():
        raise ValueError("the documents don't agree with the manifest")
    # one row a range of documents
    before = written.select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def places_of(lengths: pa.Array, owned: pa.Array) -> np.ndarray:
        """Where the kept ids of each chunk start, in bytes, over all rows."""
        return np.r_[0, np.cumsum(lengths.flatten().to_numpy().astype(np.int64) * owned.flatten().to_numpy(zero_copy_only=False))] * width

    def give(batches):
        unpack = zstd(words)[1]
        for batch in sliced(batches):
            hashes, lengths, owned, given, payload = batch.columns
            ends, places = list_ends(lengths), places_of(lengths, owned)
            raw, hit = list(map(unpack, payload.to_pylist())), np.flatnonzero(given.flatten().to_numpy(zero_copy_only=False))
            row = np.searchsorted(ends, hit, "right") - 1
            start = places[ends[row]]
            data = [raw[i][a:b] for i, a, b in zip(row.tolist(), (places[hit] - start).tolist(), (places[hit + 1] - start).tolist())]
            yield pa.RecordBatch.from_arrays([hashes.flatten().take(pa.array(hit)), pa.array(data, pa.binary())], names=["hash", "data"])

    lent = rows.where(F.exists("given", lambda x: x)).select("hashes", "lengths", "owned", "given", "payload").mapInArrow(give, "hash binary, data binary")
    missing = rows.where(F.exists("owned", lambda x: ~x)).select("part", "at", F.explode(F.filter(F.transform("hashes", lambda h, i: F.struct(i.alias("seq"), h.alias("hash"), F.get("owned", i).alias("own"))), lambda x: ~x["own"])).alias("x")).select("part", "at", "x.seq", "x.hash")
    cols = ["doc_id", "n_tokens", "lengths", "owned", "payload", "root", "part", "local_start"]
    whole = rows.where(F.forall("owned", lambda x: x)).select(*cols)
    # a row of the store and after it what it borrows; (part, at) names one. The recipe itself needn't move: its root tells
    borrowing = rows.where(F.exists("owned", lambda x: ~x)).select(*cols, "at", F.lit(-1).alias("seq"))
    borrowed = missing.join(lent, "hash").select("part", "at", "seq", "data")
    patched = borrowing.unionByName(borrowed, allowMissingColumns=True).repartition("part", "at").sortWithinPartitions("part", "at", "seq").select(*cols, "seq", "data")

    def make():
        unpack = zstd(words)[1]

        def one(doc_id, places: np.ndarray, payload: bytes, root: bytes, borrowed: list[tuple[int, bytes]]) -> bytes:
            raw = unpack(payload)
            parts = between(raw, places - places[0])
            for i, x in borrowed:
                parts[i] = x
            if merkle([digest(p) for p in parts]) != root:
                raise ValueError(f"a chunk of document {doc_id} isn't what its digest says")
            return b"".join(parts) if borrowed else raw

        def run(batch: pa.RecordBatch, till: list[int] | None = None, lent: list[tuple[int, bytes]] | None = None) -> pa.RecordBatch:
            """``till``: what each row borrows ends there in ``lent``."""
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ends, places, owned = list_ends(col["lengths"]), places_of(col["lengths"], col["owned"]), col["owned"].flatten().to_numpy(zero_copy_only=False)
            till, lent = till or [0] * (len(ends)), lent or []
            rows = zip(*(col[n].to_pylist() for n in ("doc_id", "payload", "root")), ends.tolist(), ends[1:].tolist(), till, till[1:])
            got = [one(doc_id, places[a : b + 1], payload, root, lent[c:d]) for doc_id, payload, root, a, b, c, d in rows]
            n_owned = np.add.reduceat(np.r_[owned, False].astype(np.int64), ends[:-1]) if len(got) else []
            crc = [zlib.crc32(np.frombuffer(x, kind).astype("<u4")) for x in got]
            out = {"doc_id": col["doc_id"], "part": col["part"], "local_start": col["local_start"], "n_tokens": pa.array([len(x) // width for x in got], pa.int64()), "n_chunks": pa.array(np.diff(ends), pa.int32()), "n_owned": pa.array(n_owned, pa.int32()), "ids_crc32": pa.array(crc, pa.int64())}
            if ids:
                out["ids"] = pa.array(got, pa.binary())
            return pa.RecordBatch.from_arrays([*out.values()], names=[*out])

        return run

    def patch(batches):
        run, held = make(), []

        def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
            seq = batch.column("seq").to_numpy()
            at, rest = np.flatnonzero(seq < 0), np.flatnonzero(seq >= 0)
            lent = list(zip(seq[rest].tolist(), batch.column("data").take(pa.array(rest)).to_pylist()))
            return run(batch.select(cols).take(pa.array(at)), [*(at - np.arange(len(at))).tolist(), len(rest)], lent)

        for batch in sliced(batches):
            heads = np.flatnonzero(batch.column("seq").to_numpy() < 0)
            if not len(heads):
                held.append(batch)
                continue
            # the last row may borrow more in the next batch
            last = int(heads[-1])
            yield finish(pa.concat_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield finish(pa.concat_batches(held))

    schema = "doc_id bigint, part int, local_start bigint, n_tokens bigint, n_chunks int, n_owned int, ids_crc32 bigint" + ", ids binary" * ids
    back = map_batches(whole, make, schema).unionByName(patched.mapInArrow(patch, schema))
    return back.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "n_chunks", "n_owned", *["ids"] * ids)


def report(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the store, reads it back, and gives per document its start, length and checksum."""
    return read(docs.sparkSession, write(docs, path, end_id), path, ids=False)
