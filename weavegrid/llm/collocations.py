"""Phrase collocation mining over vertical positional inverted lists.

Texts are dealt into shards of about ``SHARD_WORDS`` words, cut between
pieces, so that no phrase crosses two shards; a very long text is several. In
a shard each word (of a language) has one list, the ascending positions at
which it stands; positions skip one between pieces. Lists are extended level
by level: the occurrences of a frequent phrase are joined, by position, with
the postings of the frequent phrases that begin one place further on, which
share all words with it but the first and add the adjacent one. Where both
meet is an occurrence of the longer phrase, whose list holds those positions;
its length is the exact number of occurrences in the shard. Only these lengths
meet those of other shards: their sums over all shards are the exact
frequencies, and a phrase goes on where its sum is ``MIN_COUNT`` or more (no
phrase is more frequent than its parts, so nothing is lost).

A phrase is known by the shard and number of its first list, so keys are exact
and no dictionary is sent around. What a task holds is one shard.

Defined cases: a null text counts as empty, a null lang as ``und``; texts
without words and rows that repeat count as they stand, each row for itself;
other columns are ignored; ties are broken by phrase; a piece of more words
than a shard is one shard's work; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.llm.common import discard, few_rows_a_batch, one_row, ship, slices, stored

SHARD_WORDS = 1 << 19
#: Lists whose keys one row holds.
BLOCK_LISTS = 1 << 15
CHUNK_BYTES = 1 << 20
#: Texts that are sent to a worker at once.
DOCS_A_BATCH = 256
#: Rows of lists in a file: Parquet's reader holds a batch of rows, which are large, of one file.
ROWS_A_FILE = 32
MIN_COUNT = 30
LONGEST = 4
FIRST_OF_LANG = 2000
#: A phrase goes where a longer one around it has this many hundredths of its occurrences.
COVERED = 80
SCORE_SCALE = 2_000_000
#: Parts in which the phrases of a language are ranked before the best of all parts are.
RANK_PARTS = 256

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _chunks(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` cut before separators into parts of at most ``size`` bytes, or one word."""
    at = 0
    while len(data) - at > size:
        apart = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, size - 1, at + 1)])
        if len(apart):
            end = at + 1 + int(apart[-1])
        else:
            end = at + size
            while end < len(data) and not (rest := np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, min(size, len(data) - end), end)])).size:
                end = min(len(data), end + size)
            end = min(len(data), end + int(rest[0])) if end < len(data) else end
        yield data[at:end]
        at = end
    yield data[at:]


class _Positions:
    """Words of texts in reading order, with positions that skip one between pieces, handed out in shards."""

    def __init__(self, shard_words: int):
        self.shard_words = shard_words
        self.words: list[pa.Array] = []
        self.lang: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.held, self.next, self.piece, self.last_piece = 0, 0, 0, -1

    def add(self, data: bytes, lang: int) -> Iterator[tuple]:
        """The words of a text; yields shards as they fill up."""
        for chunk in _chunks(data, CHUNK_BYTES):
            yield from self._chunk(chunk, lang)
        self.piece += 1

    def _chunk(self, chunk: bytes, lang: int) -> Iterator[tuple]:
        b = np.frombuffer(chunk, np.uint8)
        kind = _KIND[b]
        inside = kind == _WORD
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        start, end = edges[::2], edges[1::2]
        broken = np.cumsum(kind == _BREAK)
        if len(start):
            piece = self.piece + broken[start]
            new = np.diff(piece, prepend=self.last_piece) != 0
            place = self.next + np.arange(len(start)) + np.cumsum(new)
            ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
            flat = np.ascontiguousarray(_LOWER[b[inside]])
            words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            self.last_piece, self.next = int(piece[-1]), int(place[-1]) + 1
            full = self.held + len(start) >= self.shard_words and new.any()
            cut = int(np.flatnonzero(new)[-1]) if full else 0
            if full:
                self._keep(words[:cut], np.full(cut, lang), place[:cut])
                yield self.shard()
                first = int(place[cut])
                place, self.next = place - first, self.next - first
            self._keep(words[cut:], np.full(len(start) - cut, lang), place[cut:])
        self.piece += int(broken[-1]) if len(b) else 0

    def _keep(self, words: pa.Array, lang: np.ndarray, place: np.ndarray) -> None:
        if len(words):
            self.words.append(words)
            self.lang.append(lang)
            self.place.append(place)
            self.held += len(words)

    def shard(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What is held: words, languages, positions."""
        out = pa.concat_arrays(self.words), np.concatenate(self.lang), np.concatenate(self.place)
        self.words, self.lang, self.place, self.held = [], [], [], 0
        return out


def _lists(keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the lengths of their lists, and the lists one after another."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)), place[order]


def _packed(place: np.ndarray) -> bytes:
    """Steps from one position to the next in 16 bits, and those beyond them (and from one list to the next) after these."""
    step = np.diff(place, prepend=0)
    long = (step < 0) | (step >= 65535)
    return np.int64(len(step)).tobytes() + np.where(long, 65535, step).astype("<u2").tobytes() + step[long].astype("<i4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    step = np.frombuffer(data, "<u2", n, 8).astype(np.int64)
    step[step == 65535] = np.frombuffer(data, "<i4", -1, 8 + 2 * n)
    return np.cumsum(step)


def _planes(a: np.ndarray) -> bytes:
    """First bytes of all numbers, then second bytes, and so on: shuffles compress bytes that are alike."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_ROWS = "shard long, first int, {}, n array<int>, sizes binary, places binary"
_WORD_LISTS = _ROWS.format("lang array<string>, word array<string>")
_PHRASE_LISTS = _ROWS.format("head array<long>, tail array<long>")
_PHRASE_SCHEMA = pa.schema({"shard": pa.int64(), "first": pa.int32(), **{c: pa.list_(pa.int64()) for c in ("head", "tail")}, "n": pa.list_(pa.int32()), "sizes": pa.binary(), "places": pa.binary()})


def _rows(shard: int, keys: dict[str, pa.Array], n: np.ndarray, place: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A shard as rows: keys and lengths of its lists, in blocks, and one row with all the lists."""
    names = ["shard", "first", *keys, "n", "sizes", "places"]
    nothing = pa.nulls(1, pa.binary())
    for at in range(0, len(n), BLOCK_LISTS):
        part = [one_row(k.type, k.slice(at, BLOCK_LISTS)) for k in keys.values()]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([at], pa.int32()), *part, one_row(pa.int32(), n[at : at + BLOCK_LISTS]), nothing, nothing], names=names)
    if place is not None:
        none = [pa.nulls(1, pa.list_(k.type)) for k in keys.values()]
        packed = [pa.array([n.astype("<i4").tobytes()]), pa.array([_packed(place)])]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.nulls(1, pa.int32()), *none, pa.nulls(1, pa.list_(pa.int32())), *packed], names=names)


def _word_lists(shard_words: int):
    def run(batches):
        langs: dict[str, int] = {}
        held = _Positions(shard_words)
        task = TaskContext.get()
        own = task.partitionId() if task else 0
        numbers = iter(range(own << 12, own + 1 << 12))  # below 2 ** 32 for a million tasks of 4096 shards

        def rows(words: pa.Array, lang: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            coded = words.dictionary_encode()
            keys, n, place = _lists(lang * len(coded.dictionary) + coded.indices.to_numpy(), place)
            of, word = np.divmod(keys, len(coded.dictionary))
            named = {"lang": pa.array(list(langs), pa.string()).take(pa.array(of)), "word": coded.dictionary.take(pa.array(word))}
            yield from _rows(next(numbers), named, n, place)

        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary())):
                for shard in held.add(memoryview(text.as_buffer()).tobytes() if text.is_valid else b"", langs.setdefault(lang, len(langs))):
                    yield from rows(*shard)
        if held.held:
            yield from rows(*held.shard())

    return run


_FREQUENT = "shard long, numbers binary, ids binary"


def _packed_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, number, id, sorted by the first two, as a row for each shard of a batch: steps from one number to the next, and ids."""
    for batch in batches:
        shard, number, ids = (batch.column(c).to_numpy() for c in ("shard", "number", "id"))
        at = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1))
        parts = [slice(a, b) for a, b in zip(at, [*at[1:], len(shard)])]
        steps = [_planes(np.diff(number[p], prepend=np.int32(0)).astype("<i4")) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(steps, pa.binary()), pa.array([_planes(ids[p].astype("<i8")) for p in parts], pa.binary())], names=["shard", "numbers", "ids"])


def _extended(last: bool):
    """Lists of a shard and the phrases in it that go on to the lists of phrases one word longer; of the last level only lengths are kept."""

    def run(lists: pa.Table, frequent: pa.Table) -> pa.Table:
        if not lists.num_rows or not frequent.num_rows:
            return _PHRASE_SCHEMA.empty_table()
        n = np.frombuffer(lists.column("sizes")[0].as_py(), "<i4")
        kept = np.concatenate([np.cumsum(_from_planes(d.as_py(), "<i4")) for d in frequent.column("numbers")])
        ids = np.concatenate([_from_planes(d.as_py(), "<i8") for d in frequent.column("ids")])
        place = _unpacked(lists.column("places")[0].as_py())
        phrase = np.full(len(n), -1, np.int64)
        phrase[kept] = np.arange(len(kept))
        phrase = np.repeat(phrase, n)
        place, phrase = place[phrase >= 0], phrase[phrase >= 0]
        # both sides in order of position: postings laid out by position are joined with themselves, one place on
        at = np.full(place.max(initial=0) + 2, -1, np.int64)
        at[place] = phrase
        follows = at[place + 1]
        both = follows >= 0
        keys, n, place = _lists(phrase[both] * len(kept) + follows[both], place[both])
        head, tail = np.divmod(keys, len(kept))
        rows = _rows(lists.column("shard")[0].as_py(), {"head": pa.array(ids[head]), "tail": pa.array(ids[tail])}, n, None if last else place)
        return pa.Table.from_batches([r.cast(_PHRASE_SCHEMA) for r in rows], _PHRASE_SCHEMA)

    return run


def _frequent(lists: DataFrame, key: list[str], min_count: int, name: str) -> DataFrame:
    """shard, number, id and f of every list whose phrase is frequent, and the key of the first of a phrase; a phrase's id is the least (shard, number) of its lists."""
    own = lists.where("places is null").select("shard", "first", F.posexplode(F.arrays_zip(*key, "n")).alias("at", "list"))
    # a narrow row for each list of each shard: this is the widest shuffle
    own = own.select("list.n", F.col(f"list.{key[0]}").alias(key[0]), (F.shiftleft("shard", 31) + F.col("first") + F.col("at")).alias("own"), F.col(f"list.{key[1]}").alias(key[1]))
    phrase = Window.partitionBy(*key)
    own = own.withColumns({"f": F.sum(F.col("n").cast("long")).over(phrase), "id": F.min("own").over(phrase)}).where(F.col("f") >= min_count)
    first = F.col("own") == F.col("id")
    columns = [F.shiftright("own", 31).alias("shard"), (F.col("own").bitwiseAND((1 << 31) - 1)).cast("int").alias("number"), "id", "f"]
    return stored(own.select(*columns, *[F.when(first, F.col(c)).alias(c) for c in key], first.alias("is_first")), name, tidy=True)


def _joined_lists(lists: DataFrame, frequent: DataFrame, last: bool) -> DataFrame:
    # a group is a shard; both sides are sorted by it, so no task holds the lists of two
    whole = lists.where("places is not null").select("shard", "sizes", "places").groupBy("shard")
    # what goes back to the shards is packed before the shuffle
    own = frequent.select("shard", "number", "id").sortWithinPartitions("shard", "number").mapInArrow(_packed_frequent, _FREQUENT)
    joined = whole.cogroup(own.groupBy("shard")).applyInArrow(_extended(last), _PHRASE_LISTS)
    return stored(joined, "phrase-lists", tidy=True, rows_a_file=ROWS_A_FILE)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: lang, n (its words); and of every phrase of one to ``longest`` words that occurs ``min_count`` times or more in a
    lang: lang, k (words), id, phrase, f, heads and tails (frequencies of its first and last 1, 2, .. k words), inside (k, id of the shorter ones of two words or more in it)."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with few_rows_a_batch(docs.sparkSession, DOCS_A_BATCH):
        lists = stored(rows.mapInArrow(_word_lists(shard_words), _WORD_LISTS), "word-lists", rows_a_file=ROWS_A_FILE)
    totals = lists.where("places is null").select(F.explode(F.arrays_zip("lang", "n")).alias("own")).groupBy("own.lang").agg(F.sum(F.col("own.n").cast("long")).alias("n"))
    totals = stored(totals, "words")
    frequent = _frequent(lists, ["lang", "word"], min_count, "frequent")
    none = F.array().cast("array<struct<k:int,id:bigint>>")
    found = stored(
        frequent.where("is_first").select(
            "lang", F.lit(1).alias("k"), "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"), none.alias("inside")
        ),
        "phrases",
    )
    levels = [found]
    for k in range(2, longest + 1):
        spent = lists, frequent
        lists = _joined_lists(lists, frequent, k == longest)
        for table in spent:
            discard(table)
        frequent = _frequent(lists, ["head", "tail"], min_count, "frequent")
        head = levels[-1].select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first_words"), "heads", F.col("inside").alias("in_head"))
        tail = levels[-1].select(F.col("id").alias("tail"), "last", "tails", F.col("inside").alias("in_tail"))
        parts = F.array(*[F.struct(F.lit(k - 1).alias("k"), F.col(c).alias("id")) for c in ("head", "tail")]) if k > 2 else none
        found = (
            frequent.where("is_first")
            .select("id", "f", "head", "tail")
            .join(head, "head")
            .join(tail, "tail")
            .select(
                "lang",
                F.lit(k).alias("k"),
                "id",
                F.concat_ws(" ", "first_words", "last").alias("phrase"),
                "last",
                "f",
                F.concat("heads", F.array("f")).alias("heads"),
                F.concat("tails", F.array("f")).alias("tails"),
                F.array_union(parts, F.array_union("in_head", "in_tail")).alias("inside"),
            )
        )
        levels.append(stored(found, "phrases", tidy=True))
    discard(lists)
    discard(frequent)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return totals, found.drop("last")


def collocations(docs: DataFrame, first: int = FIRST_OF_LANG, min_count: int = MIN_COUNT, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``first`` phrases of two words or more of each lang by score: lang, rank, phrase, a (occurrences), l and r (those of the parts of the lowest-scoring cut), n (words of the lang), score.

    A phrase that a longer frequent one covers in ``COVERED`` hundredths of its occurrences is left out.
    """
    totals, found = phrases(docs, min_count, longest, shard_words)
    found = found.where("k >= 2")
    around = found.select(F.explode("inside").alias("part"), "f").groupBy(F.col("part.k").alias("k"), F.col("part.id").alias("id")).agg(F.max("f").alias("longer"))
    whole = "decimal(20,0)"
    kept = found.join(around, ["k", "id"], "left").where(F.col("longer").isNull() | (F.col("longer").cast(whole) * 100 < F.col("f").cast(whole) * COVERED))

    exact = "cast({} as decimal(20,0))".format
    l, r = "element_at(heads, j)", "element_at(tails, k - j)"  # noqa: E741
    score = f"cast({SCORE_SCALE} as decimal(7,0)) * {exact('f')} div ({exact(l)} + {exact(r)})"
    lowest = F.expr(f"array_min(transform(sequence(1, k - 1), j -> struct({score} as score, j as j, {l} as l, {r} as r)))")
    scored = kept.select("lang", "phrase", F.col("f").alias("a"), lowest.alias("cut")).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

