"""Line dedup by a deletion-neighbourhood join.

Lines are linked if they have equal words, or if one insertion, deletion or replacement of a word makes them equal and
the longer has MIN_WORDS words or more (a parameter; 1 compares all). Each line gives its own hash and those of all variants
without one word. Lines whose hashes meet are spelled: equal variants without the word at the same place are a replacement,
a variant that equals a whole line is a deletion. A line that is linked to an earlier one goes.

A line's name is 128 bits: a tabulation hash and half of a BLAKE2b digest of its words. Hashes only bring variants
together; whether they are equal is decided by 128-bit digests of what they spell, and links are verified word by word.

Variants outnumber lines by far. They are sorted in each batch, dealt into buckets by value and sent as one binary value
a bucket: gaps between hashes, line numbers and places as byte planes, a few bytes a variant. Of lines of a batch that share
a variant, one is sent for all, so that a bucket holds a hot variant once a batch at most.
"""

from __future__ import annotations

import math
import struct
from hashlib import blake2b
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import bounded_batches, documents, materialize, stored, whole_text
from gridloom.llm.words import WHITE, LineHasher, Lines, Reader, line_sums, mixed

MIN_WORDS = 5
KEY_BITS = 48
#: A bucket gets the variants of about so many bytes of text.
BUCKET_BYTES = 8 << 20
#: Variants that a task holds before it sends them.
HELD = 1 << 19
#: Bits of a bitmap for each distinct line, and the most bits as a power of 2 (64 MB). Bitmaps only spare work that surely
#: isn't needed; one that fills up spares less.
FILTER_SHARE, FILTER_MOST = 8, 29
NAME = ["hash", "check"]


def _planes(values: np.ndarray) -> bytes:
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = data[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n).T
    return out.reshape(-1).view("<u8"), at + 1 + width * n


def _encoded(key: np.ndarray, line: np.ndarray, place: np.ndarray) -> bytes:
    gaps = np.diff(key, prepend=np.uint64(0))
    return struct.pack("<I", len(key)) + _planes(gaps) + _planes(line) + _planes(place)


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    gaps, at = _unplaned(data, 4, n)
    line, at = _unplaned(data, at, n)
    place, _ = _unplaned(data, at, n)
    return np.cumsum(gaps, dtype=np.uint64), line.astype(np.int64), place.astype(np.int64)


def _words(slab: Lines, lines: np.ndarray) -> list[bytes]:
    """The words of lines, space-joined."""
    raw = slab.data.tobytes()
    return [b" ".join(raw[a:b].split()) for a, b in zip(slab.start[lines].tolist(), slab.end[lines].tolist(), strict=True)]


def _checks(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in words]), np.int64) if words else np.zeros(0, np.int64)


def _read_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, th (of id and text), number, hash and check (of the words; null for a line without) of each line."""
    fed = docs.select(F.col(id_col).alias("id"), _th(id_col, text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), fed.schema["id"], T.StructField("th", T.LongType()), T.StructField("number", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in NAME]])

    def run(batches):
        from pyspark import TaskContext

        reader, hasher, row = Reader(WHITE, False), LineHasher(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for slab in reader.slabs(batch["text"]):
                whole = hasher.whole(line_sums(hasher, slab), slab.word[:-1], slab.word[1:])
                at, none = pa.array(slab.doc), slab.word[1:] == slab.word[:-1]
                check = _checks(_words(slab, np.arange(len(none))))
                yield pa.RecordBatch.from_arrays([pa.array(row + slab.doc), batch["id"].take(at), batch["th"].take(at), pa.array(slab.number, pa.int32()), pa.array(whole.view(np.int64), mask=none), pa.array(check, mask=none)], schema.names)
            row += batch.num_rows

    bounded_batches(docs.sparkSession)
    return fed.mapInArrow(run, schema)


def _th(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), whole_text(text_col))


def _filter_bits(lines: int) -> int:
    return min(FILTER_MOST, max(16, math.ceil(math.log2(FILTER_SHARE * max(1, lines)))))


def _bit_words(positions: DataFrame) -> DataFrame:
    """word, bits of a bitmap with the column `pos` set: at most as many rows as the bitmap has 64 bits."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    return positions.groupBy(F.expr("pos div 64").alias("word")).agg(F.bit_or(one).alias("bits"))


def _position(column: str, bits: int):
    return F.shiftrightunsigned(F.col(column), 64 - bits)


def _bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """The bitmap as bytes: 2^bits / 8 of them."""
    out = np.zeros((1 << bits) // 64, np.int64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _is_set(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _token(hashes: np.ndarray, th: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Names an occurrence of a line: a hash of what mixed() and a linear mix make of its hash, document and number."""
    return mixed(hashes ^ mixed(th + number.astype(np.uint64)))


def _place(th: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of a line's document and number."""
    return mixed(th + mixed(number.astype(np.uint64)))


def _first_only(firsts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct lines (hash, at, n): two bitmaps, of hashes that several lines have, and of the earliest occurrences
    of all hashes that the first bitmap has, be it by chance.

    They keep copies from giving the same variants again: what is in neither, or in the second, gives them. Where the
    bitmaps fill up, some copies do too and meet themselves, which costs time but changes nothing.
    """
    pos = firsts.withColumn("pos", _position("hash", bits))
    dense = materialize(_bit_words(pos.where("n > 1")))
    marked = pos.withColumn("word", F.expr("pos div 64")).join(dense, "word")
    is_set = F.call_function("shiftrightunsigned", F.col("bits"), (F.col("pos") % 64).cast("int")).bitwiseAND(1) == 1
    stay = marked.where(is_set).select("hash", F.col("at.o3").alias("th"), F.col("at.o5").alias("number"))

    def run(batches):
        for batch in batches:
            value = _token(batch["hash"].to_numpy().view(np.uint64), batch["th"].to_numpy().view(np.uint64), batch["number"].to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((value >> np.uint64(64 - bits)).astype(np.int64))], ["pos"])

    return _bitmap(dense, bits), _bitmap(_bit_words(stay.mapInArrow(run, "pos long")), bits)


def _order():
    """Of lines: by id, null ids last, then by text, row and number."""
    return F.struct(F.col("id").isNull().alias("o1"), F.col("id").alias("o2"), F.col("th").alias("o3"), F.col("row").alias("o4"), F.col("number").alias("o5"))


class _Held:
    """Variants that wait to be sent: hashes, lines (places in `lines` and `checks`, the names of lines) and places in the
    line."""

    def __init__(self):
        self.size, self.lines, self.checks = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.keys, self.owners, self.places = [], [], []

    def add(self, hashes: np.ndarray, owners: np.ndarray, places: np.ndarray) -> None:
        self.keys.append(hashes >> np.uint64(64 - KEY_BITS))
        self.owners.append(owners.astype(np.uint32))
        self.places.append(places.astype(np.uint32))
        self.size += len(hashes)

    def sent(self, batch: int, buckets: int) -> pa.RecordBatch:
        """A blob for each bucket, one of entries that met in this batch (MET), and one of the lines' names (NAMES)."""
        key, owner, place = map(np.concatenate, (self.keys, self.owners, self.places))
        # Places beyond 16 bits only miss being told to be equal.
        order = np.argsort(key << np.uint64(16) | np.minimum(place, 65_535).astype(np.uint64))
        key, owner, place = key[order], owner[order], place[order]
        again = np.r_[False, (key[1:] == key[:-1]) & (place[1:] == place[:-1])]
        met = _encoded(key[again], owner[again], place[again])
        # A sign that others of the batch share the variant goes with the entry that is sent for them.
        shared = np.r_[again[1:], False][~again]
        key, owner, place = key[~again], owner[~again], place[~again] * 2 + shared
        edges = -(-(np.arange(buckets + 1).astype(object) << KEY_BITS) // buckets)
        cut = np.searchsorted(key, np.array([int(e) for e in edges], np.uint64))
        full = np.flatnonzero(np.diff(cut))
        blobs = [_encoded(key[cut[k] : cut[k + 1]], owner[cut[k] : cut[k + 1]], place[cut[k] : cut[k + 1]]) for k in full]
        names = np.stack([self.lines.view(np.int64), self.checks]).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([*full, MET, NAMES], pa.int32()), pa.array(np.full(len(full) + 2, batch)), pa.array([*blobs, met, names], pa.binary())], ["bucket", "batch", "blob"])


NAMES, MET = -1, -2


def _variants(docs: DataFrame, id_col: str, text_col: str, buckets: int, bitmaps: tuple[np.ndarray, np.ndarray], min_words: int) -> DataFrame:
    """bucket, batch, blob: the variants of a batch's lines in a bucket; and see _Held.sent."""
    fed = docs.select(_th(id_col, text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches):
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() << 24
        several, chosen = shared.value
        reader, hasher = Reader(WHITE, False), LineHasher()
        held = _Held()
        for batch in batches:
            th = batch["th"].to_numpy().view(np.uint64)
            for slab in reader.slabs(batch["text"]):
                sums, a, b = line_sums(hasher, slab), slab.word[:-1], slab.word[1:]
                whole = hasher.whole(sums, a, b)
                gives = (b > a) & (~_is_set(several, whole) | _is_set(chosen, _token(whole, th[slab.doc], slab.number)))
                # Within what is held a line gives its variants once.
                distinct, first = np.unique(whole[gives], return_index=True)
                fresh = ~np.isin(distinct, held.lines)
                at = np.flatnonzero(gives)[first[fresh]]
                base = len(held.lines)
                held.lines = np.concatenate([held.lines, distinct[fresh]])
                held.checks = np.concatenate([held.checks, _checks(_words(slab, at))])
                held.add(whole[at], base + np.arange(len(at)), np.zeros(len(at)))
                long = np.flatnonzero(b[at] - a[at] >= min_words)
                count = (b - a)[at][long]
                which = np.repeat(long, count)
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                low = a[at][which]
                held.add(hasher.without(sums, low, b[at][which], low + place), base + which, place + 1)
                if held.size >= HELD:
                    yield held.sent(own, buckets)
                    own, held = own + 1, _Held()
        if held.size:
            yield held.sent(own, buckets)

    bounded_batches(docs.sparkSession)
    return fed.mapInArrow(run, "bucket int, batch long, blob binary")


def _met(variants: DataFrame, buckets: int) -> DataFrame:
    """key, place (0: the whole line), batch, line of the hashes that different lines share; and, with null keys, the
    rows of names with `blob`. A bucket holds the values of its range, of which each batch sends one blob."""

    def meeting(blobs):
        parts = [(*_decoded(data), own) for own, data in blobs]
        if not parts:
            return
        key, line, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
        batch = np.repeat([p[3] for p in parts], [len(p[0]) for p in parts])
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.r_[False, key[1:] == key[:-1]]
        met = (place[order] & 1) > 0
        shared = same | np.r_[same[1:], False] | met
        key, order, met = key[shared], order[shared], met[shared]
        if not len(key):
            return
        line, place, batch = line[order], place[order] >> 1, batch[order]
        # Something must meet: a whole line and another entry, or two with the word left out at one place.
        order = np.lexsort((place, key))
        key, line, place, batch, met = key[order], line[order], place[order], batch[order], met[order]
        run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        sub = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])]) - 1
        keep = (np.bincount(run, weights=place == 0) > 0)[run] | (np.bincount(sub) > 1)[sub] | met
        n = int(keep.sum())
        yield pa.RecordBatch.from_arrays([pa.array(key[keep].astype(np.int64)), pa.array(place[keep], pa.int32()), pa.array(batch[keep]), pa.array(line[keep], pa.int32()), pa.nulls(n, pa.binary())], names)

    def run(batches):
        held, at = [], None
        for batch in batches:
            for bucket, own, data in zip(batch["bucket"].to_pylist(), batch["batch"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                if bucket == NAMES:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([own]), pa.nulls(1, pa.int32()), pa.array([data], pa.binary())], names)
                elif bucket == MET:
                    key, line, place = _decoded(data)
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(place, pa.int32()), pa.array(np.full(len(key), own)), pa.array(line, pa.int32()), pa.nulls(len(key), pa.binary())], names)
                else:
                    if bucket != at:
                        yield from meeting(held)
                        held, at = [], bucket
                    held.append((own, data))
        yield from meeting(held)

    names = ["key", "place", "batch", "line", "blob"]
    # Name rows spread by their batch.
    spread = F.when(F.col("bucket") < 0, -1 - F.col("batch")).otherwise(F.col("bucket").cast("long"))
    # A bucket a task at most, however many there are.
    tasks = max(int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    return variants.repartitionById(tasks, F.pmod(spread, F.lit(tasks)).cast("int")).sortWithinPartitions("bucket").mapInArrow(run, "key long, place int, batch long, line int, blob binary")


def _entries(met: DataFrame) -> DataFrame:
    """hash, check, places: of each line that met another, the places of the words that its variants there lack."""

    def run(batches):
        for batch in batches:
            for own, data in zip(batch["batch"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                both = np.frombuffer(data, np.int64).reshape(2, -1)
                n = both.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own)), pa.array(np.arange(n), pa.int32()), *[pa.array(x) for x in both]], ["batch", "line", *NAME])

    named = met.where("key IS NULL").select("batch", "blob").mapInArrow(run, "batch long, line int, hash long, check long")
    found = met.where("key IS NOT NULL").select("place", "batch", "line").join(named, ["batch", "line"])
    return found.groupBy(*NAME).agg(F.collect_set("place").alias("places"))


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, bits: int) -> DataFrame:
    """hash, check, words (space-joined) of the lines whose name is wanted (hash, check, at). Texts are cut at line feeds;
    of the lines only those are read whose place may be the earliest of a wanted name, by a bitmap of places."""
    spark = docs.sparkSession

    def mark(batches):
        for batch in batches:
            value = _place(batch["th"].to_numpy().view(np.uint64), batch["number"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((value >> np.uint64(64 - bits)).astype(np.int64))], ["pos"])

    places = wanted.select(F.col("at.o3").alias("th"), F.col("at.o5").alias("number")).mapInArrow(mark, "pos long")
    shared = spark.sparkContext.broadcast(_bitmap(_bit_words(places), bits))

    def run(batches):
        reader, hasher, bitmap = Reader(WHITE, False), LineHasher(), shared.value
        for batch in batches:
            lines = [t.split("\n") for t in batch["text"].to_pylist()]
            count = np.array([len(x) for x in lines], np.int64)
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = _is_set(bitmap, _place(np.repeat(batch["th"].to_numpy().view(np.uint64), count), number))
            for slab in reader.slabs(pa.array(compress(chain.from_iterable(lines), found.tolist()), pa.string())):
                a, b = slab.word[:-1], slab.word[1:]
                whole = hasher.whole(line_sums(hasher, slab), a, b)
                at = np.flatnonzero(b > a)
                words = _words(slab, at)
                yield pa.RecordBatch.from_arrays([pa.array(whole[at].view(np.int64)), pa.array(_checks(words)), pa.array([w.decode() for w in words], pa.string())], [*NAME, "words"])

    bounded_batches(spark)
    found = docs.select(_th(id_col, text_col).alias("th"), whole_text(text_col).alias("text")).mapInArrow(run, "hash long, check long, words string")
    return found.join(wanted.select(*NAME), NAME, "left_semi").groupBy(*NAME).agg(F.min("words").alias("words"))


def _spelled(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """hash, check, place, digest: of what each entry of a line spells without the word at the place (0: with all)."""

    def run(batches):
        for batch in batches:
            rows, places, digests = [], [], []
            for k, (line, own) in enumerate(zip(batch["words"].to_pylist(), batch["places"].to_pylist(), strict=True)):
                words = line.encode().split(b" ")
                for place in own:
                    rows.append(k)
                    places.append(place)
                    digests.append(blake2b(b" ".join(words[: place - 1] + words[place:]) if place else b" ".join(words), digest_size=16).digest())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in NAME], pa.array(places, pa.int32()), pa.array(digests, pa.binary())], [*NAME, "place", "digest"])

    return entries.join(texts, NAME).select(*NAME, "places", "words").mapInArrow(run, "hash long, check long, place int, digest binary")


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one insertion, deletion or replacement of a word at most makes a and b equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _verified(pairs: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """The names of lines, of pairs hash, check, to, to_check, whose lines are within the bound."""
    both = pairs.join(texts, NAME).join(texts.select(F.col("hash").alias("to"), F.col("check").alias("to_check"), F.col("words").alias("to_words")), ["to", "to_check"]).select(*NAME, "words", "to_words")

    def run(batches):
        for batch in batches:
            good = [within_one(a.split(" "), b.split(" ")) and max(a.count(" "), b.count(" ")) + 1 >= min_words for a, b in zip(batch["words"].to_pylist(), batch["to_words"].to_pylist(), strict=True)]
            yield batch.select(NAME).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "hash long, check long").distinct()


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each line: row, id, th, number (from 0), decision: 'keep', 'exact' or 'near'.

    Lines end at line feeds. Earlier means a smaller id (null ids last), then within the text. A line goes as 'exact'
    if an earlier one has equal words, else as 'near' if an earlier one is within one edit of a word (and the longer has
    min_words words or more), whether or not that one stays. Lines without words stay. Null texts count as empty: one line
    without words.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    lines = stored(_read_lines(docs, id_col, text_col))
    # Distinct lines: their earliest occurrence and how many there are. A common line is summed up before it is dealt.
    firsts = stored(lines.where("hash IS NOT NULL").groupBy(*NAME).agg(F.min(_order()).alias("at"), F.count(F.lit(1)).alias("n")))
    bits = _filter_bits(firsts.count())
    buckets = max(16, size // BUCKET_BYTES + 1)
    variants = _variants(docs, id_col, text_col, buckets, _first_only(firsts, bits), min_words)
    entries = stored(_entries(stored(_met(variants, buckets))))
    # Lines that have copies or meet another.
    meets = entries.select(*NAME).withColumn("meets", F.lit(True))
    first = stored(firsts.join(meets, NAME, "left").where("n > 1 OR meets").select(*NAME, "at"))
    texts = stored(_texts(docs, id_col, text_col, first.join(meets.select(*NAME), NAME, "left_semi"), bits))
    spelled = stored(_spelled(entries, texts).join(first, NAME))
    early = F.min(F.struct("at", *NAME)).alias("early")
    # Replacement: variants that spell the same without the word at one place. Deletion: a whole line and variants.
    replaced = spelled.where("place > 0").groupBy("digest", "place").agg(early, F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = [spelled.join(replaced, ["digest", "place"]).select(*NAME, "at", "early")]
    sides = spelled.groupBy("digest", (F.col("place") == 0).alias("whole")).agg(early)
    other = sides.select("digest", (~F.col("whole")).alias("whole"), "early")
    pairs.append(spelled.withColumn("whole", F.col("place") == 0).join(other, ["digest", "whole"]).select(*NAME, "at", "early"))
    pairs = pairs[0].unionByName(pairs[1]).where(F.col("early.at") < F.col("at")).select(*NAME, F.col("early.hash").alias("to"), F.col("early.check").alias("to_check")).distinct()
    near = _verified(stored(pairs), texts, min_words).withColumn("near", F.lit(True))
    facts = stored(first.join(near, NAME, "left"))
    decided = lines.join(facts, NAME, "left")
    kind = F.when(F.col("at").isNull(), "keep").when(_order() != F.col("at"), "exact").when(F.col("near"), "near").otherwise("keep")
    return decided.select("row", "id", "th", "number", kind.alias("decision"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay, in their order; n_chars, if there, is the new text's length. Null texts stay null."""
    gone = line_decisions(docs, id_col, text_col).groupBy("row", "id", "th").agg(F.array_sort(F.collect_list(F.when(F.col("decision") != "keep", F.col("number")))).alias("gone"))
    # Rows that repeat both id and text take the lists in turn.
    lists = gone.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("row", "gone"))).alias("__gl_lists")).withColumnsRenamed({"id": "__gl_id", "th": "__gl_th"})
    rows = docs.withColumn("__gl_of", _th(id_col, text_col)).join(lists, F.col(id_col).eqNullSafe(F.col("__gl_id")) & (F.col("__gl_of") == F.col("__gl_th")))
    rows = rows.withColumn("__gl_turn", F.row_number().over(Window.partitionBy("__gl_id", "__gl_th").orderBy("__gl_id")))
    own = F.element_at("__gl_lists", F.col("__gl_turn"))["gone"]
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(own, i)), "\n")
    rows = rows.withColumn(text_col, kept)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its lines, those that stay, go as exact and go as near copies, and the sum of the
    numbers of the lines that stay."""
    found = line_decisions(documents(spark, sf_dir))
    count = lambda k: F.count_if(F.col("decision") == k)
    made = found.groupBy("row", F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), count("keep").alias("kept_lines"), count("exact").alias("exact_dropped"), count("near").alias("near_dropped"), F.coalesce(F.sum(F.when(F.col("decision") == "keep", F.col("number").cast("long"))), F.lit(0)).alias("kept_sum"))
    return made.drop("row")


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, CAST(number AS BIGINT) AS number, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS number FROM documents)),
f AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min((doc_id, number)) AS o FROM l WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT t, o, p, array_to_string(list_concat(w[:p - 1], w[p + 1:]), ' ') AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM f WHERE len(w) >= 5)),
r AS (SELECT p, x, min(o) AS early FROM v GROUP BY p, x HAVING count(DISTINCT t) > 1),
near AS (
  SELECT v.t FROM v JOIN r ON r.p = v.p AND r.x = v.x WHERE r.early < v.o
  UNION SELECT v.t FROM v JOIN f ON f.t = v.x WHERE f.o < v.o
  UNION SELECT f.t FROM v JOIN f ON f.t = v.x WHERE v.o < f.o),
k AS (
  SELECT l.doc_id, l.number, CASE WHEN f.t IS NULL THEN 'keep' WHEN (l.doc_id, l.number) <> f.o THEN 'exact' WHEN near.t IS NOT NULL THEN 'near' ELSE 'keep' END AS decision
  FROM l LEFT JOIN f ON len(l.w) > 0 AND f.t = array_to_string(l.w, ' ') LEFT JOIN near ON near.t = f.t)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (decision = 'keep') AS kept_lines, count(*) FILTER (decision = 'exact') AS exact_dropped,
       count(*) FILTER (decision = 'near') AS near_dropped, CAST(coalesce(sum(number) FILTER (decision = 'keep'), 0) AS BIGINT) AS kept_sum
FROM k GROUP BY doc_id
"""
