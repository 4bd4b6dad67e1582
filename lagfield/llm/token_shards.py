"""Token ids of documents in binary shards, with a minimal perfect hash index over their keys.

A shard is a file of records in ascending ``doc_id`` order: a header of 16 bytes (number of ids, flags, key), the ids
as little-endian unsigned numbers with the end id last, and two closing bytes.  Spark's own text writer puts them out,
so any store and its commit protocol will do.  The index is a table of blocks of about ``BLOCK_KEYS`` keys: in a block each
key has a slot of its own that holds its fingerprint and the place of its record, so a look-up reads one block and
touches one slot.
"""

from __future__ import annotations

import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagfield.llm.common import materialize
from lagfield.llm.shingles import slices

END_ID = 2
HEADER = np.dtype([("n", "<u4"), ("flags", "<u4"), ("key", "<i8")])
CLOSE = "\x1e\x1e"
SHARD_BYTES = 16 << 20
BLOCK_KEYS = 1024
SHARD_GROUP = 4096
CACHE_WORDS = 600_000
SLICE_BYTES = 4 << 20

_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTERS = "".join(map(chr, (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
_MARKS = ".,!?;:#$%&*|"


class WordEncoder:
    """Encodes texts by the tokenizer, asking it for each piece only once while it is remembered.

    This vocabulary never joins pieces over white space, and letters and marks of a word are pieces of their own, so the ids of a
    text are those of its words one after another.  A block of texts looks up each of its different words once; letters and marks
    are remembered apart, as new words are mostly known letters before other marks.  A text with unusual white space goes to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        self.by_word = len(ends) > 0
        self.forget()

    def forget(self):
        self.pieces = {}
        self.ids, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n = self.used = 0

    def whole(self, texts):
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, names, ids, lens):
        """Remember the ids of pieces."""
        first, used = self.n, self.used
        self.n, self.used = first + len(lens), used + len(ids)
        if self.n > len(self.lens):
            more = np.zeros(self.n, np.int64)
            self.starts, self.lens = np.concatenate([self.starts, more]), np.concatenate([self.lens, more])
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used, np.uint32)])
        self.ids[used : self.used] = ids
        self.lens[first : self.n] = lens
        self.starts[first : self.n] = used + np.cumsum(lens) - lens
        self.pieces.update(zip(names, range(first, self.n), strict=True))

    def _learn(self, letters, others):
        """Remember new pieces: lower-case letters, many to a text, and others, each a text of its own."""
        for i in range(0, len(letters), 2000):
            part = letters[i : i + 2000]
            got = np.array(self.whole([" ".join(part)])[0], np.uint32)
            self._store(part, got, np.diff(np.flatnonzero(self.is_end[got]) + 1, prepend=0))
        got = self.whole(others)
        self._store(others, np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64))

    def _entries(self, pieces):
        """Entry of each piece, the unknown ones learned."""
        pieces = pieces.dictionary_encode()
        known, names = self.pieces, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in names if w not in known]
        if new:
            plain = _plain(pa.array(new, pa.large_string())).to_pylist()
            self._learn(*([w for w, p in zip(new, plain, strict=True) if p == kind] for kind in (True, False)))
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))[pieces.indices.to_numpy()]

    def _ids_of(self, words):
        """Ids of words one after another, and where each ends."""
        letters = pc.utf8_rtrim(words, _MARKS)
        plain = _plain(letters)
        both = np.empty(2 * len(words), np.int64)
        both[::2] = self._entries(pc.if_else(plain, pc.utf8_lower(letters), words))
        both[1::2] = self._entries(pc.if_else(plain, pc.utf8_ltrim(words, _LETTERS), ""))
        ids, ends = _gather(self.ids, self.starts[both], self.lens[both])
        return ids, ends[1::2]

    def encode(self, texts):
        """One array of ids for each text."""
        if not self.by_word:
            return [np.array(x, np.uint32) for x in self.whole(texts)]
        out, start = [None] * len(texts), 0
        while start < len(texts):  # blocks of texts bound memory
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 4 << 20):
                size += len(texts[stop])
                stop += 1
            self._block(texts, start, stop, out)
            start = stop
        return out

    def _block(self, texts, start, stop, out):
        if self.n > CACHE_WORDS:
            self.forget()
        mine = []
        for i in range(start, stop):
            if _ODD.search(texts[i]):
                out[i] = np.array(self.whole([texts[i]])[0], np.uint32)
            else:
                mine.append(i)
        split = pc.ascii_split_whitespace(pa.array([texts[i] for i in mine], pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids, ends = self._ids_of(words.dictionary)
        lens = np.diff(ends, prepend=0)
        codes = words.indices.to_numpy()
        ids, ends = _gather(ids, (ends - lens)[codes], lens[codes])
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        for j, i in enumerate(mine):
            out[i] = ids[bounds[j] : bounds[j + 1]]


def _plain(words):
    """Whether words are letters of ``_LETTERS`` alone."""
    return pc.and_(pc.greater(pc.binary_length(words), 0), pc.equal(pc.binary_length(pc.utf8_ltrim(words, _LETTERS)), 0))


def _gather(ids, starts, lens):
    """Runs of ``ids`` one after another, and where each ends."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - (ends - lens), lens) + np.arange(total)], ends


def _encoder(path):
    """One encoder for each Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    if path not in vars(kept):
        setattr(kept, path, WordEncoder(path))
    return getattr(kept, path)


def _records(tokenizer, end_id, dtype):
    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in slices(batches, 1, SLICE_BYTES):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for key, ids in zip(keys, encoder.encode([t or "" for t in texts]), strict=True):
                head = np.zeros(1, HEADER)
                head["n"], head["flags"], head["key"] = len(ids) + 1, key is None, key or 0
                out.append(head.tobytes() + np.append(ids, end_id).astype(dtype).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def id_type(tokenizer: str) -> str:
    """Two bytes an id where the vocabulary allows."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
) -> str:
    """Write the shards of ``docs`` below ``folder``/shards and return the type of their ids.

    Each text (null: empty) is encoded whole and closed with ``end_id``.  Shards are ranges of ``doc_id``, null first; rows that repeat
    an id follow each other and may spread over shards.  A shard holds about ``shard_bytes`` of text.
    """
    dtype = id_type(tokenizer)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("nth")
    )
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ordered = rows.repartitionByRange(1 + size // shard_bytes, "key", "nth").sortWithinPartitions("key", "nth")
    records = ordered.select("key", "text").mapInArrow(_records(tokenizer, end_id, dtype), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", CLOSE).text(f"{folder}/shards")
    return dtype


def _walk(dtype, with_ids):
    width, close = np.dtype(dtype).itemsize, CLOSE.encode()

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(data.as_buffer())
                out = {k: [] for k in ("offset", "nth", "doc_id", "n_tokens", "ids_crc32", "before", "ids")}
                place = before = 0
                while place < len(data):
                    head = np.frombuffer(data, HEADER, 1, place)[0]
                    n = int(head["n"])
                    stop = place + HEADER.itemsize + n * width
                    if bytes(data[stop : stop + len(close)]) != close:
                        raise ValueError(f"damaged record at {place} of {path}")
                    ids = np.frombuffer(data, dtype, n, place + HEADER.itemsize)
                    out["offset"].append(place)
                    out["nth"].append(len(out["nth"]))
                    out["doc_id"].append(None if head["flags"] else int(head["key"]))
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    out["before"].append(before)
                    out["ids"].append(ids.astype(np.int32) if with_ids else None)
                    before += n
                    place = stop + len(close)
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
                arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rsplit("/", 1)[-1]] * len(out["nth"]), pa.string()), *arrays],
                    names=["shard", *out],
                )

    return run


def read_shards(
    spark: SparkSession, folder: str, dtype: str, with_ids: bool = False, shards: list[str] | None = None
) -> DataFrame:
    """Every record of all shards, or of the named ones, which alone are opened: ``shard, offset, nth, doc_id, n_tokens, ids_crc32, before`` (ids before it in its
    shard) and ``ids`` (null unless asked for).  A record without its closing bytes is an error."""
    files = spark.read.format("binaryFile").load(
        f"{folder}/shards" if shards is None else [f"{folder}/shards/{name}" for name in shards]
    ).select("path", "content")
    return files.mapInArrow(
        _walk(dtype, with_ids),
        "shard string, offset bigint, nth bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, before bigint,"
        " ids array<int>",
    )


def _key_hash(key, nth, seed):
    return F.xxhash64(F.lit(seed), key, nth)


def _mixed(h, seed):
    x = (h ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def perfect_seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a minimal perfect hash of distinct 64-bit numbers, and the slot of each.

    Keys fall into groups of four on average; the largest group first, each takes the first seed that sends its keys to free
    slots.  The single keys at the end take the free slots as they are: their seed is -1 - slot.
    """
    n = len(hashes)
    groups = max(1, n // 4)
    group = (hashes % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    firsts = np.cumsum(sizes) - sizes
    seeds, slots, free = np.zeros(groups, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for g in by_size[sizes[by_size] > 1]:
        mine = order[firsts[g] : firsts[g] + sizes[g]]
        first = 1
        while True:
            tries = np.arange(first, first + 64, dtype=np.uint64)
            at = (_mixed(hashes[mine][None, :], 0) * (2 * tries[:, None] + np.uint64(1)) >> np.uint64(20)) % np.uint64(n)
            at = at.astype(np.int64)
            good = free[at].all(1)
            if len(mine) > 1:
                ranked = np.sort(at, 1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                seeds[g], slots[mine] = int(tries[k]), at[k]
                free[at[k]] = False
                break
            first += 64
    left = iter(np.flatnonzero(free))
    for g in by_size[sizes[by_size] == 1]:
        slots[order[firsts[g]]] = slot = next(left)
        seeds[g] = -1 - slot
    return seeds, slots


def slots_of(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key: two look-ups, whatever the number of keys."""
    seed = seeds[(hashes % np.uint64(len(seeds))).astype(np.int64)]
    at = (_mixed(hashes, 0) * (2 * seed.astype(np.uint64) + np.uint64(1)) >> np.uint64(20)) % np.uint64(n)
    return np.where(seed < 0, -1 - seed, at.astype(np.int64))


def _build(frame):
    import pandas as pd

    h = frame["hash"].to_numpy(np.int64).view(np.uint64)
    seeds, slots = perfect_seeds(h)
    order = np.argsort(slots)
    return pd.DataFrame(
        {
            "block": [int(frame["block"].iloc[0])],
            "n": [len(frame)],
            "seeds": [seeds.tolist()],
            "prints": [frame["print"].to_numpy()[order].tolist()],
            "shards": [frame["shard"].to_numpy()[order].tolist()],
            "offsets": [frame["offset"].to_numpy()[order].tolist()],
        }
    )


def _keyed(keys: DataFrame, blocks: int) -> DataFrame:
    """Hash, fingerprint and block of keys ``doc_id, copy``."""
    h = lambda seed: F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("doc_id").isNull(), F.col("copy"))
    return keys.withColumns({"hash": h(1), "print": F.shiftright(h(2), 32).cast("int"), "block": F.pmod(h(3), F.lit(blocks))})


def shard_number(shard: Column) -> Column:
    """The number in a shard's file name; as text, part-100000 would come before part-99999."""
    return F.regexp_extract(shard, r"part-([0-9]+)", 1).cast("long")


def _before(totals: DataFrame, value: str) -> DataFrame:
    """``shard, first``: the sum of ``value`` over the shards before, in the order of their numbers.

    Shards are added up in groups of ``SHARD_GROUP``, so that no task sees all of them; one orders the groups' sums.
    """
    rows = totals.withColumn("number", shard_number(F.col("shard")))
    rows = rows.withColumn("group", F.floor(F.col("number") / SHARD_GROUP))
    so_far = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("group").agg(F.sum(value).alias(value))
    groups = groups.select("group", so_far(Window.orderBy("group")).alias("earlier"))
    inside = rows.select("shard", "group", so_far(Window.partitionBy("group").orderBy("number")).alias("inside"))
    return inside.join(groups, "group").select("shard", (F.col("earlier") + F.col("inside")).alias("first"))


def write_index(records: DataFrame, folder: str, block_keys: int = BLOCK_KEYS) -> int:
    """Write the index of ``records`` (see ``read_shards``) to ``folder``/index and return its number of blocks.

    The key is ``doc_id`` with a copy number from 0, which tells rows that repeat an id apart.  Copies follow each other in
    the shards, so a copy's number is its place less the first place of its id, and no group is gathered.
    """
    first = _before(records.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")), "rows")
    placed = records.join(first, "shard").withColumn("place", F.col("first") + F.col("nth"))
    least = placed.groupBy("doc_id").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    repeated = least.where("n > 1").select(F.col("doc_id").alias("id"), "least")
    keys = placed.join(repeated, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", F.coalesce(F.col("place") - F.col("least"), F.lit(0)).alias("copy"), "shard", "offset"
    )
    blocks = 1 + records.count() // block_keys
    built = _keyed(keys, blocks).groupBy("block").applyInPandas(
        _build,
        "block bigint, n bigint, seeds array<bigint>, prints array<int>, shards array<string>, offsets array<bigint>",
    )
    built.sortWithinPartitions("block").write.parquet(f"{folder}/index")
    return blocks


def _find(batches):
    for batch in batches:
        out = {"doc_id": [], "copy": [], "shard": [], "offset": []}
        for row in batch.to_pylist():
            asked = row["asked"]
            h = np.array([a["hash"] for a in asked], np.int64).view(np.uint64)
            slots = slots_of(h, np.array(row["seeds"], np.int64), row["n"])
            for a, slot in zip(asked, slots.tolist(), strict=True):
                if slot < row["n"] and row["prints"][slot] == a["print"]:
                    out["doc_id"].append(a["doc_id"])
                    out["copy"].append(a["copy"])
                    out["shard"].append(row["shards"][slot])
                    out["offset"].append(row["offsets"][slot])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out)
        )


def look_up(keys: DataFrame, folder: str, blocks: int) -> DataFrame:
    """``doc_id, copy, shard, offset`` of the keys ``doc_id, copy`` that the index holds; other keys give no row
    (but for one in 2**32 whose fingerprint agrees by chance; the record's own key tells it)."""
    asked = (
        _keyed(keys.select("doc_id", "copy").distinct(), blocks)
        .groupBy("block")
        .agg(F.collect_list(F.struct("doc_id", "copy", "hash", "print")).alias("asked"))
    )
    index = keys.sparkSession.read.parquet(f"{folder}/index").select("block", "n", "seeds", "prints", "shards", "offsets")
    return asked.join(index, "block").mapInArrow(_find, "doc_id bigint, copy bigint, shard string, offset bigint")


def fetch(keys: DataFrame, folder: str, blocks: int, dtype: str) -> DataFrame:
    """``doc_id, copy, ids`` of the keys ``doc_id, copy`` from the shards, by their places in the index.

    Only the shards that hold a key are opened.  Their names pass through the driver, one for each key asked for at
    most: this is the read for a request's keys, ``read_shards`` the one for a whole collection.
    """
    spark = keys.sparkSession
    found = materialize(look_up(keys, folder, blocks), "token-places")
    names = sorted(r.shard for r in found.select("shard").distinct().collect())
    if not names:
        return spark.createDataFrame([], "doc_id bigint, copy bigint, ids array<int>")
    records = read_shards(spark, folder, dtype, with_ids=True, shards=names)
    both = found.join(records.select(F.col("doc_id").alias("own"), "shard", "offset", "ids"), ["shard", "offset"])
    return both.where(F.col("doc_id").eqNullSafe(F.col("own"))).select("doc_id", "copy", "ids")


def token_table(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Write shards and index below ``folder``, then find every document of ``docs`` through the index and read it back.

    Returns ``doc_id, start, n_tokens, ids_crc32, shard, offset``; ``start`` counts the ids of all documents before it.  A null or
    empty text has the end id alone; a null id comes first and is a key of its own; rows that repeat an id have a row
    each; an empty table gives no rows; further columns are not looked at.
    """
    dtype = write_shards(docs, folder, tokenizer, doc_id, text, **options)
    records = materialize(read_shards(docs.sparkSession, folder, dtype).drop("ids"), "token-records")
    blocks = write_index(records, folder)
    starts = _before(records.groupBy("shard").agg(F.sum("n_tokens").alias("ids")), "ids")
    keys = docs.groupBy(F.col(doc_id).cast("long").alias("doc_id")).count().select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy")
    )
    found = look_up(keys, folder, blocks)
    own = records.withColumnRenamed("doc_id", "own").join(starts, "shard")
    return (
        found.join(own, ["shard", "offset"])
        .where(F.col("doc_id").eqNullSafe(F.col("own")))
        .select(
            "doc_id",
            (F.col("first") + F.col("before")).alias("start"),
            "n_tokens",
            "ids_crc32",
            "shard",
            "offset",
        )
    )
