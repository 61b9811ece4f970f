"""Phrase collocations: pairs of frequency-ranked ids are counted tile by tile, and frequent pairs become ids of their own."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, slices, staged, text_bytes

#: Lower-case letters; a tab is a space, and what ends a piece one byte that UTF-8 never has.
_END = 0xFF
_FOLD = bytes(_END if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

LONGEST = 5
LEAST_COUNT = 100
#: Ids on a side of a tile. A tile that gets an entry for a quarter of its places is counted in a dense array.
TILE, DENSE = 1 << 9, 4
#: Pairs that a task gathers before it adds them to its counts, and counts that it holds before it hands them on.
GATHER, HELD = 1 << 20, 1 << 21
#: Words' ids are sent to every task if there are so many at most (some 150 bytes each, so 80 MB), and pairs' ids if there are
#: so many times more (12 bytes each, so 50 MB); of larger tables each chunk of text is joined with those that it holds.
SENT_ROWS, PAIRS_FOR_WORD = 1 << 19, 8

#: Ids as compressed 32-bit integers, ``size`` of them; heads are null where they are the words themselves.
CHUNK = "chunk long, lang string, size int, words binary, heads binary"
#: A chunk before its words have ids: its distinct words with spaces between, and the place of each of ``size`` tokens among them.
SPELT = "chunk long, lang string, size int, distinct binary, places binary"


def _tokens(raw: np.ndarray) -> list[bytes]:
    """The words of a text, with a lone ``_END`` byte where a piece ends."""
    return raw.tobytes().translate(_FOLD).replace(b"\xff", b" \xff ").split(b" ")


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The tokens of a batch's texts by language, a slice of them at a time."""
    langs = batch.column(1).to_pylist()
    data, offs = text_bytes(batch.column(0))
    for i, j in slices(offs):
        found: dict[str, list[bytes]] = {}
        for k in range(i, j):
            found.setdefault("und" if langs[k] is None else langs[k], []).extend([*_tokens(data[offs[k] : offs[k + 1]]), b"\xff"])
        yield from found.items()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            for gone in (b"", b"\xff"):
                c.pop(gone, None)
            yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, tokens in _by_lang(batch):
            counts.setdefault(lang, Counter()).update(tokens)
        if sum(map(len, counts.values())) > HELD // 4:
            yield from told()
    yield from told()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all documents' words."""
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    return texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, *ties: str) -> DataFrame:
    """``counts`` (lang, n, ...) with id: from 0 on by n descending within each lang. No window holds more than the rows of
    one lang and n, or the different n of a lang."""
    steps = counts.groupBy("lang", "n").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("lang", "n").orderBy(*ties)) - 1
    return counts.withColumn("here", here).join(steps.select("lang", "n", before.alias("before")), ["lang", "n"]).withColumn("id", (F.col("before") + F.col("here")).cast("int")).drop("before", "here")


def _sent(spark: SparkSession, table: DataFrame, most: int) -> Broadcast | None:
    """The staged ``table`` for every task, if it has ``most`` rows at most: words as dictionaries, pairs as sorted arrays."""
    if table.count() > most:
        return None
    got = table.toArrow().combine_chunks()
    langs = got.column("lang").combine_chunks().dictionary_encode()
    ids = got.column("id").to_numpy()
    out = {}
    for n, lang in enumerate(langs.dictionary.to_pylist()):
        at = np.flatnonzero(langs.indices.to_numpy() == n)
        if "word" in got.column_names:
            out[lang] = dict(zip((w.encode() for w in got.column("word").take(at).to_pylist()), ids[at].tolist(), strict=True))
        else:
            code = _code(got.column("i").to_numpy()[at], got.column("j").to_numpy()[at])
            order = np.argsort(code)
            out[lang] = (code[order], ids[at][order])
    return spark.sparkContext.broadcast(out)


def _code(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (i.astype(np.int64) << 32) | j.astype(np.int64)


def _found(codes: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The id of each code, -1 if it has none."""
    if table is None or not len(table[0]):
        return np.full(len(codes), -1, np.int32)
    at = np.minimum(np.searchsorted(table[0], codes), len(table[0]) - 1)
    return np.where(table[0][at] == codes, table[1][at], -1).astype(np.int32)


def _short(words: np.ndarray, heads: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Without what no phrase of more than ``width`` words can hold: a word stays if a frequent phrase of ``width`` covers
    it; of the places between, one stays."""
    covered, starts = np.zeros(len(words) + 1, np.int32), np.flatnonzero(heads >= 0)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    keep = np.cumsum(covered)[:-1] > 0
    words, heads = np.where(keep, words, -1), np.where(keep, heads, -1)
    keep[1:] |= keep[:-1]
    return words[keep], heads[keep]


def _packed(ids: np.ndarray | None) -> bytes | None:
    return None if ids is None else pa.compress(ids.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _chunk(lang: str, words: np.ndarray, heads: np.ndarray | None) -> pa.RecordBatch:
    columns = [pa.array([None], pa.int64()), pa.array([lang]), pa.array([len(words)], pa.int32()), pa.array([_packed(words)], pa.binary()), pa.array([_packed(heads)], pa.binary())]
    return pa.record_batch(columns, names=["chunk", "lang", "size", "words", "heads"])


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, words, heads) of each chunk."""
    for batch in batches:
        for n in range(batch.num_rows):
            lang, size, words, heads = (batch.column(c)[n].as_py() for c in ("lang", "size", "words", "heads"))
            words, heads = (None if x is None else np.frombuffer(pa.decompress(x, decompressed_size=4 * size, codec="zstd"), "<i4") for x in (words, heads))
            yield lang, words, words if heads is None else heads


def _pairs(words: np.ndarray, heads: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase of ``width`` + 1 words may start, as each of its two phrases of ``width`` words is frequent; and the
    pairs of its head and its last word."""
    at = np.flatnonzero((heads[: len(heads) - width] >= 0) & (heads[1 : len(heads) - width + 1] >= 0)) if len(heads) > width else np.zeros(0, np.int64)
    return at, _code(heads[at], words[at + width])


def tile_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of pairs and their counts. Pairs are dealt to tiles by both ids' ranks: what falls into a tile that is
    full enough is counted in place, the rest is sorted."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    i, j = codes >> 32, codes & 0xFFFFFFFF
    tile = ((i // TILE) << 32) | (j // TILE)
    names, tile, sizes = np.unique(tile, return_inverse=True, return_counts=True)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    full = sizes >= TILE * TILE // DENSE
    for t in np.flatnonzero(full):
        mine = tile == t
        places = np.bincount((i[mine] % TILE) * TILE + j[mine] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(places)
        out.append((_code((names[t] >> 32) * TILE + at // TILE, (names[t] & 0xFFFFFFFF) * TILE + at % TILE), places[at]))
    out.append(np.unique(codes[~full[tile]], return_counts=True))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n, first) if len(n) else n


def _count_pairs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        nothing, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0

        def count() -> None:
            for lang in list(waiting):
                new, old = tile_counts(np.concatenate(waiting.pop(lang))), held.get(lang, nothing)
                held[lang] = _added(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]))

        def told() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                code, n = held.pop(lang)
                for k in range(0, len(code), GATHER):
                    c = code[k : k + GATHER]
                    yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array((c >> 32).astype(np.int32)), pa.array((c & 0xFFFFFFFF).astype(np.int32)), pa.array(n[k : k + GATHER])], names=["lang", "i", "j", "n"])

        for lang, words, heads in _chunks_of(batches):
            waiting.setdefault(lang, []).append(_pairs(words, heads, width)[1])
            size += len(waiting[lang][-1])
            if size > GATHER:
                count()
                size = 0
                if sum(len(h[0]) for h in held.values()) > HELD:
                    yield from told()
        count()
        yield from told()

    return run


def _encode_sent(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, tokens in _by_lang(batch):
                words = np.fromiter(map(sent.value.get(lang, {}).get, filter(None, tokens), repeat(-1)), np.int32)
                yield _chunk(lang, _short(words, words, 1)[0], None)

    return run


def _extend_sent(sent: Broadcast, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, heads in _chunks_of(batches):
            at, codes = _pairs(words, heads, width)
            longer = np.full(len(words), -1, np.int32)
            longer[at] = _found(codes, sent.value.get(lang))
            if (longer >= 0).any():
                yield _chunk(lang, *_short(words, longer, width + 1))

    return run


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk (``SPELT``) for each slice of texts and language."""
    for batch in batches:
        for lang, tokens in _by_lang(batch):
            tokens = [t for t in tokens if t]
            place = {w: n for n, w in enumerate(dict.fromkeys(tokens))}
            places = np.fromiter(map(place.__getitem__, tokens), np.int32)
            columns = [pa.array([None], pa.int64()), pa.array([lang]), pa.array([len(tokens)], pa.int32()), pa.array([b" ".join(place)], pa.binary()), pa.array([_packed(places)], pa.binary())]
            yield pa.record_batch(columns, names=["chunk", "lang", "size", "distinct", "places"])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, lang, word, place) of the distinct words of each chunk."""
    for batch in batches:
        for n in range(batch.num_rows):
            chunk, lang, distinct = (batch.column(c)[n].as_py() for c in ("chunk", "lang", "distinct"))
            # the byte that ends a piece is no word: its place has no id
            at, words = zip(*((k, w) for k, w in enumerate(distinct.split(b" ")) if w != b"\xff"), strict=True) if distinct != b"\xff" else ((), ())
            yield pa.record_batch([pa.array([chunk] * len(at), pa.int64()), pa.array([lang] * len(at), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(at, pa.int32())], names=["chunk", "lang", "word", "place"])


def _pairs_of(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, lang, i, j) of the distinct pairs of each chunk."""
        for batch in batches:
            for n, (lang, words, heads) in enumerate(_chunks_of(iter([batch]))):
                c = np.unique(_pairs(words, heads, width)[1])
                yield pa.record_batch([pa.array([batch.column("chunk")[n].as_py()] * len(c), pa.int64()), pa.array([lang] * len(c), pa.string()), pa.array((c >> 32).astype(np.int32)), pa.array((c & 0xFFFFFFFF).astype(np.int32))], names=["chunk", "lang", "i", "j"])

    return run


def _encode_met(met: pa.Table, chunk: pa.Table) -> pa.Table:
    lang, size, places = (chunk.column(c)[0].as_py() for c in ("lang", "size", "places"))
    places = np.frombuffer(pa.decompress(places, decompressed_size=4 * size, codec="zstd"), "<i4")
    ids = np.full(places.max() + 1, -1, np.int32)
    ids[met.column("place").to_numpy()] = met.column("id").to_numpy()
    return pa.Table.from_batches([_chunk(lang, _short(ids[places], ids[places], 1)[0], None)])


def _extend_met(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(met: pa.Table, chunk: pa.Table) -> pa.Table:
        ((lang, words, heads),) = _chunks_of(chunk.to_batches())
        code = _code(met.column("i").to_numpy(), met.column("j").to_numpy())
        order = np.argsort(code)
        at, codes = _pairs(words, heads, width)
        longer = np.full(len(words), -1, np.int32)
        longer[at] = _found(codes, (code[order], met.column("id").to_numpy()[order]))
        out = _chunk(lang, *_short(words, longer, width + 1))
        return pa.Table.from_batches([out] if (longer >= 0).any() else [], out.schema)

    return run


def _met(met: DataFrame, chunks: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """What ``work`` makes of each chunk and of the ids that ``met`` has for its distinct words or pairs; staged. A task holds
    those of one chunk at a time, as many as a slice of texts has."""
    out = met.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(work, CHUNK)
    return staged(out.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def encode(docs: DataFrame, words: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Chunks of texts (``CHUNK``): the id of each word, -1 where it isn't frequent or a piece ends; staged."""
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    if (sent := _sent(docs.sparkSession, words.select("lang", "word", "id"), sent_rows)) is not None:
        return staged(texts.mapInArrow(_encode_sent(sent), CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    spelt = staged(texts.mapInArrow(_spelt, SPELT).withColumn("chunk", F.monotonically_increasing_id()), "spelt")
    distinct = spelt.mapInArrow(_words_of, "chunk long, lang string, word string, place int")
    met = distinct.join(words.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "place", "id")
    out = _met(met, spelt.drop("distinct"), _encode_met)
    discard(spelt)
    return out


def extend(chunks: DataFrame, pairs: DataFrame, width: int, sent_rows: int = SENT_ROWS) -> DataFrame:
    """``chunks`` with heads of ``width`` + 1 words instead of ``width``; staged."""
    table = pairs.select("lang", "i", "j", "id")
    if (sent := _sent(chunks.sparkSession, table, sent_rows * PAIRS_FOR_WORD)) is not None:
        return staged(chunks.mapInArrow(_extend_sent(sent, width), CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    distinct = chunks.mapInArrow(_pairs_of(width), "chunk long, lang string, i int, j int")
    return _met(distinct.join(table, ["lang", "i", "j"]).select("chunk", "i", "j", "id"), chunks, _extend_met(width))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, sent_rows: int = SENT_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """(counts, phrases): counts (lang, total) of all word occurrences; and for each length from 1 the staged phrases that
    occur ``least`` times or more: (lang, id, phrase, n, firsts, rests, head_id, tail). firsts and rests hold for each cut
    after the first k words how often either side occurs.

    A longer phrase is a pair: the id of the frequent phrase that it starts with, and its last word's. No phrase is
    frequent unless both phrases of one word less are.
    """
    every = staged(word_counts(docs), "words")
    totals = staged(every.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    nothing = F.array().cast("array<long>")
    words = staged(ranked(every.filter(F.col("n") >= least), "word"), "frequent")
    discard(every)
    levels = [staged(words.select("lang", "id", F.col("word").alias("phrase"), "n", nothing.alias("firsts"), nothing.alias("rests"), F.lit(None).cast("int").alias("head_id"), F.lit("").alias("tail")), "phrases1")]
    chunks = encode(docs, words, sent_rows)
    last = words.select("lang", F.col("id").alias("j"), F.col("word").alias("last"))
    for width in range(1, longest):
        counts = chunks.mapInArrow(_count_pairs(width), "lang string, i int, j int, n long").groupBy("lang", "i", "j").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        pairs = staged(ranked(counts, "i", "j"), "pairs")
        heads = levels[-1].select("lang", F.col("id").alias("i"), F.col("phrase").alias("head"), F.col("n").alias("head_n"), F.col("firsts").alias("head_firsts"))
        named = pairs.join(heads, ["lang", "i"]).join(last, ["lang", "j"])
        # all words but the first, which are a frequent phrase too
        tail = F.concat_ws(" ", F.when(F.instr("head", " ") > 0, F.expr("substring(head, instr(head, ' ') + 1)")), "last")
        tails = levels[-1].select("lang", F.col("phrase").alias("tail"), F.col("n").alias("tail_n"), F.col("rests").alias("tail_rests"))
        named = named.withColumn("tail", tail).join(tails, ["lang", "tail"])
        levels.append(staged(named.select(
            "lang", "id", F.concat_ws(" ", "head", "last").alias("phrase"), "n", F.concat("head_firsts", F.array("head_n")).alias("firsts"), F.concat(F.array("tail_n"), "tail_rests").alias("rests"), F.col("i").alias("head_id"), "tail",
        ), f"phrases{width + 1}"))
        if width + 1 < longest:
            longer = extend(chunks, pairs, width, sent_rows)
            discard(chunks)
            chunks = longer
        discard(pairs)
    discard(chunks, words)
    return totals, levels


def collocations(docs: DataFrame, top: int = 2000, longest: int = LONGEST, least: int = LEAST_COUNT, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    score is floor(1000 * a * n / (l * r)) of the lowest-scoring cut, computed in decimals of 38 digits. A phrase goes
    if a longer candidate that holds it occurs as often; then so does one of just one word more. Null text: empty; null
    lang: ``und``. Repeated rows count as often as they stand there. No document or no candidate: no row. Other columns
    aren't read.
    """
    totals, levels = frequent_phrases(docs, longest, least, sent_rows)
    out = None
    for shorter, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        kept = shorter
        if longer is not None:
            n = F.col("n")
            within = longer.select("lang", F.col("head_id").alias("id"), "tail", n)
            kept = kept.join(within.select("lang", "id", n), ["lang", "id", "n"], "left_anti").join(within.select("lang", F.col("tail").alias("phrase"), n), ["lang", "phrase", "n"], "left_anti")
        kept = kept.select("lang", "phrase", "n", "firsts", "rests")
        out = kept if out is None else out.unionByName(kept)
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    big = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    a_n = f"CAST({big('n')} * {big('total')} AS DECIMAL(35, 0)) * 1000BD"
    cut = f"transform(sequence(1, size(firsts)), k -> struct(CAST({wide(a_n)} div ({big('firsts[k - 1]')} * {big('rests[k - 1]')}) AS long) AS score, k, firsts[k - 1] AS l, rests[k - 1] AS r))"
    scored = out.join(totals, "lang").withColumn("cut", F.array_min(F.expr(cut)))
    scored = scored.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
