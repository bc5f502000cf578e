"""Shared helpers: inputs, staged tables in the cluster's shared folder, fixed-size filters."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Membership filters are broadcast: FILTER_BITS for each member, FILTER_MOST bits in all (32 MB); beyond that there is none.
FILTER_BITS = 10
FILTER_MOST = 1 << 28
#: Bits of a filter's chunk; a key's bits lie in one chunk.
CHUNK_BITS = 1 << 16
#: Bytes of text that a task splits into words at a time.
PIECE_BYTES = 4 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only in local mode (tests), where tasks and driver share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: staged tables need a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tallyspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends at files that outlive executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bit(k: int) -> str:
    return f"cast(shiftrightunsigned(__hash, {16 * k}) & {CHUNK_BITS - 1} as int)"


def _hash(key: Column) -> Column:
    return F.xxhash64(F.lit(1), key)


def filter_chunks(members: DataFrame, chunk: Column, key: Column) -> DataFrame:
    """(chunk, words): for every chunk that has members, a Bloom filter of CHUNK_BITS bits in 64-bit words, four bits a member."""
    bits = members.select(chunk.alias("chunk"), _hash(key).alias("__hash"))
    bits = bits.select("chunk", F.explode(F.array(*[F.expr(_bit(k)) for k in range(4)])).alias("bit"))
    words = bits.groupBy("chunk", F.expr("cast(bit / 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits"))
    words = words.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return words.select("chunk", F.expr(f"transform(sequence(0, {CHUNK_BITS // 64 - 1}), w -> coalesce(try_element_at(words, w), 0L))").alias("words"))


def probe_chunks(df: DataFrame, chunk: Column, key: Column, chunks: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean column: false only where ``key`` is surely not among the members of its chunk. Null chunks have none."""
    own, at, words, h = spare(df, "chunk", "held", "words", "hash")
    probe = df.withColumn(own, chunk).withColumn(h, _hash(key))
    held = chunks.select(F.col("chunk").alias(at), F.col("words").alias(words))
    hit = F.lit(True)
    for k in range(4):
        bit = _bit(k).replace("__hash", h)
        hit &= F.expr(f"(shiftright(get({words}, cast({bit} / 64 as int)), {bit} % 64) & 1L) = 1L")
    return probe.join(F.broadcast(held), F.col(own) == F.col(at), "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop(own, at, words, h)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"__{name}"
        while new in taken:
            new += "_"
        out.append(new)
        taken.add(new)
    return out


def flag_maybe_in(df: DataFrame, key: str, members: DataFrame, member_key: str, flag: str) -> DataFrame:
    """``df`` with a boolean column: false only where ``key`` is surely not in ``members``.

    The members become a Bloom filter of FILTER_BITS bits for each, which is broadcast, so rows that cannot match need not
    take part in a shuffle; about 1 in 80 of them is flagged all the same. Members are counted first: where the filter
    would have more than FILTER_MOST bits there is none, and all keys but null are flagged. Null keys never match.
    """
    kind = members.schema[member_key].dataType
    members = members.where(F.col(member_key).isNotNull())
    n = -(-max(members.count(), 1) * FILTER_BITS // CHUNK_BITS)
    if n * CHUNK_BITS > FILTER_MOST:
        return df.withColumn(flag, F.col(key).isNotNull())
    chunk = lambda c: F.when(c.isNotNull(), F.pmod(F.xxhash64(c), F.lit(n)).cast("int"))
    own = F.col(key).cast(kind)
    return probe_chunks(df, chunk(own), own, filter_chunks(members, chunk(F.col(member_key)), F.col(member_key)), flag)


def maybe_in(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    """The rows that ``flag_maybe_in`` does not rule out."""
    (flag,) = spare(df, "maybe")
    return flag_maybe_in(df, key, members, member_key, flag).where(flag).drop(flag)


def join_texts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The texts whose ``id`` is among the members, with the members' columns; of the others few are shuffled."""
    return maybe_in(texts, "id", members, "id").join(members, "id")


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """The rows whose text a predicate keeps, all columns as they are, without a shuffle. Only the text goes to Python, and a mask comes back.

    ``make`` is called once in each task; the predicate gets texts as UTF-8 (null: empty), a few megabytes at a time.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep = make()
        for batch in batches:
            texts = (t.encode() if (t := x.as_py()) else b"" for x in batch)
            yield pa.array([k for some in by_bytes(texts) for k in keep(some)], pa.bool_())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # as types, which the session reads
    return df.where(F.arrow_udf(run, "boolean")(F.col(text_col)))


def without(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    """The rows of ``df`` whose key is not in ``members``; null keys stay. Only rows that may be there are shuffled."""
    flag, gone_key = spare(df, "maybe", "gone")
    flagged = flag_maybe_in(df, key, members, member_key, flag)
    asked = flagged.where(flag).drop(flag)
    gone = members.select(F.col(member_key).alias(gone_key)).distinct()
    left = asked.join(gone, asked[key] == gone[gone_key], "left_anti")
    return flagged.where(~F.col(flag)).drop(flag).unionByName(left)


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def md5_long(*parts: Column | str) -> Column:
    """A 52-bit hash of the parts, the same in other SQL engines: the first 13 hex digits of their md5."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def md5_unit(*parts: Column | str) -> Column:
    """The same hash as a number above 0 and below 1."""
    return (md5_long(*parts).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def pieces_at_blanks(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end at a blank."""
    at = 0
    while len(text) - at > size and (blank := _BLANK.search(text, at + size)):
        yield text[at : blank.end()]
        at = blank.end()
    yield text[at:] if at else text


def word_chunks(text: bytes, overlap: int, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text with A-Z in lower case, in chunks; each begins with the last ``overlap`` words of the one before.

    A chunk has more than ``overlap`` words, unless the whole text has no more. A text without words has no chunk.
    """
    words: list[bytes] = []
    first = True
    for piece in pieces_at_blanks(text, size):
        words += piece.lower().split()
        if len(words) > overlap:
            yield words
            words, first = words[len(words) - overlap :], False
    if words and first:
        yield words


def by_bytes(texts: Iterator[bytes], size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The texts in lists of about ``size`` bytes."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n
