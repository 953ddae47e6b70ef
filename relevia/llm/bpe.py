"""Encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.sources import materialize, most_frequent

NONE = 2**31 - 1  # rank of a pair that the vocabulary doesn't have
BUCKETS = 8192
# Fixed value: how the vocabulary's texts are cut into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte pieces and their ranks, which are also their ids, from a rank file of base64 pieces."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def words_of(text: Column) -> Column:
    """The words of a text in order; white space is Unicode's, as in the vocabulary's own pattern."""
    java = WORDS.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
    return F.regexp_extract_all(text, F.lit(java), 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one constant: an array of small maps by checksum, so that a lookup reads a handful of entries.

    A byte is the character of its number; the size is that of the vocabulary, whatever the corpus."""
    cells: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        cells[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(cells)), "array<map<string,int>>")


def merged(word: Column, ranks: Column) -> Column:
    """Ids of a word: a fold over its bytes that joins, step by step, the leftmost pair of the lowest rank."""
    bytes_ = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")

    def fold(table: Column) -> Column:
        def rank(piece: Column) -> Column:
            cell = F.get(table, F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int"))
            return F.coalesce(F.try_element_at(cell, piece), F.lit(NONE))

        def pair(p: Column, i: Column) -> Column:
            return rank(F.concat(F.get(p, i), F.get(p, i + 1)))

        def join(s: Column, k: Column) -> Column:  # k: the place of the pair, from 1
            p, r, n = s["p"], s["r"], F.size(s["r"])

            def put(piece: Column) -> Column:
                before = F.when(k > 1, F.array(rank(F.concat(F.get(p, k - 2), piece)))).otherwise(F.array().cast("array<int>"))
                after = F.when(k < n, F.array(rank(F.concat(piece, F.get(p, k + 1))))).otherwise(F.array().cast("array<int>"))
                pieces = F.concat(F.slice(p, F.lit(1), k - 1), F.array(piece), F.slice(p, k + 2, n))
                return F.struct(pieces.alias("p"), F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), before, after, F.slice(r, k + 2, n)).alias("r"))

            return let(F.concat(F.get(p, k - 1), F.get(p, k)), put)

        def step(s: Column, _: Column) -> Column:
            return let(F.array_min(s["r"]), lambda low: F.when(low.isNull() | (low == NONE), s).otherwise(let(F.array_position(s["r"], low).cast("int"), lambda k: join(s, k))))

        def run(p: Column) -> Column:
            gaps = F.when(F.size(p) > 1, F.sequence(F.lit(0), F.size(p) - 2)).otherwise(F.array().cast("array<int>"))
            start = F.struct(p.alias("p"), F.transform(gaps, lambda i: pair(p, i)).alias("r"))
            return F.transform(F.aggregate(gaps, start, step)["p"], rank)

        return let(bytes_, run)

    return let(ranks, fold)


def long_word_encoder(ranks: dict[bytes, int]) -> Callable:
    """The same merges for words too long to be copied at every step: a heap over linked pieces."""
    @F.pandas_udf("array<int>")
    def encode(words):  # noqa: ANN001, ANN202
        return words.map(lambda w: _heap_merge(w.encode(), ranks))

    return encode


def _heap_merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(raw)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def push(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (r := ranks.get(raw[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        push(before[i])
    return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]


def encoded_words(seen: DataFrame, word: str, ranks: dict[bytes, int], long: int = 256) -> DataFrame:
    """``seen`` with the ids of every word.

    Words of more than ``long`` bytes take the same merges by a heap, as each step of the fold copies the word's pieces:
    its time grows with the square of the length, the heap's hardly faster than the length."""
    short = seen.where(F.octet_length(word) <= long).withColumn("ids", merged(F.col(word), rank_literal(ranks)))
    rest = seen.where(F.octet_length(word) > long)
    if rest.limit(1).count():
        short = short.unionByName(rest.withColumn("ids", long_word_encoder(ranks)(word)))
    return short


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _assemble(batches: Iterator[pa.RecordBatch], words: pa.Array, first: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Lists of words to lists of ids by lookup; a word outside ``words`` gives the negative of its place, from 1, among
    the text's other words, which come along."""
    first, ids = (first, ids) if len(words) else (np.zeros(2, np.int64), np.zeros(1, np.int32))
    for batch in _slices(batches):
        lists = batch.column("words")
        flat = lists.flatten()
        at = pc.index_in(flat, words)
        known = np.asarray(at.is_valid())
        at = np.asarray(at.fill_null(0))
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
        misses = np.concatenate([[0], np.cumsum(~known)])
        size = np.where(known, first[at + 1] - first[at], 1)
        ends = np.cumsum(size)
        place = np.repeat(first[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        out = ids[np.where(np.repeat(known, size), place, 0)].astype(np.int32)
        lost = np.flatnonzero(~known)
        out[(ends - size)[lost]] = misses[bounds[np.searchsorted(bounds, lost, side="right") - 1]] - misses[lost] - 1
        made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[bounds].astype(np.int32)), pa.array(out))
        rest = pa.ListArray.from_arrays(pa.array(misses[bounds].astype(np.int32)), flat.take(pa.array(lost)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), made, rest], names=["row", "key", "ids", "rest"])


def encode_corpus(texts: DataFrame, key: str, text: str, ranks: dict[bytes, int], table_words: int = 100_000, table_bytes: int = 64) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens; null and empty texts give an empty list.

    Texts are cut into words once, and only distinct words are merged. The most frequent words of at most ``table_bytes``
    bytes, ``table_words`` at most, go to every task (a bound of about 32 MB) and are looked up where the texts lie. Of the
    other words, each of them rare, only the places meet the words' ids by join and are put in afterwards. Rows have
    numbers of their own, so keys may repeat or be null; other columns are ignored."""
    kind = texts.schema[key].dataType.simpleString()
    cut = materialize(texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("words")))
    seen = materialize(cut.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    words = materialize(encoded_words(seen, "word", ranks))
    top = most_frequent(words.where(F.octet_length("word") <= table_bytes), "n", table_words).select("word", "ids").toArrow()
    lists = top.column("ids").combine_chunks()
    first, ids = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values).astype(np.int32)
    shared = texts.sparkSession.sparkContext.broadcast((top.column("word").combine_chunks(), first, ids))
    near = cut.mapInArrow(lambda b: _assemble(b, *shared.value), f"row bigint, key {kind}, ids array<int>, rest array<string>")
    if words.count() > top.num_rows:
        near = materialize(near)
        places = near.select("row", F.posexplode("rest").alias("pos", "word")).join(words.select("word", F.col("ids").alias("own")), "word")
        found = places.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"]).alias("put"))
        filled = F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(F.get("put", -1 - i))))
        whole, open_ = near.where(F.size("rest") == 0).select("key", "ids"), near.where(F.size("rest") > 0)
        near = whole.unionByName(open_.join(found, "row").select("key", filled.alias("ids")))
    return near.select(F.col("key").alias(key), "ids")


def decode_corpus(encoded: DataFrame, key: str, ids: str, ranks: dict[bytes, int]) -> DataFrame:
    """(key, text): the texts of lists of ids, by joining the ids' byte pieces; a null list gives null, an unknown id raises."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table = F.from_json(F.lit(json.dumps([p.decode("latin-1") for p in pieces])), "array<string>")
    joined = let(table, lambda t: F.array_join(F.transform(F.col(ids), lambda i: F.element_at(t, i + 1)), ""))
    return encoded.select(F.col(key), F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8").alias("text"))


def ranks_of(spark: SparkSession, folder: str = "/opt/tokenizers", name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """Ranks of a public vocabulary; the folder may be set as ``spark.relevia.tokenizers``."""
    return read_ranks(f"{spark.conf.get('spark.relevia.tokenizers', folder)}/{name}.tiktoken")
