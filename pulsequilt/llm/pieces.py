"""SentencePiece encoding and decoding on a relational lattice.

Texts part into units where no piece of the vocabulary reaches across (white
space marks open a unit; runs of letters, runs of other marks and single
digits stand apart, as long as the pieces allow it). Each distinct unit of the
corpus becomes a lattice: substrings of at most the longest piece's length are
exploded, joined by equality to the piece table, and grouped by unit again. A
fold with Spark's higher-order ``aggregate`` turns the lattice into ids:

* ``viterbi`` finds the path of greatest score, as unigram models ask for;
* ``merges_in_order`` replays byte-pair merging by piece rank, and ``merges``
  does so for the few units that need more than one pass over their edges. A
  BPE model's ids are not those of any best path (its scores are ranks of
  merges), so these folds give what the library gives for models of that kind.

Characters without a piece become byte pieces. Units too long for a fold's
64-bit state go through a merge queue in Python, with the same result.

Files are cut into slices of neighbouring rows with a bounded number of units,
however large a file is. Each slice gets the ids of its own units as a table in
the shared folder; encoding reads the texts again with the one slice's table at
hand, so no text and no occurrence of a unit is shuffled. A null text is empty
and has no ids. Repeated rows are encoded each. Decoding gives the text back; a
U+2581 in it, which the vocabulary does not tell from a space, comes back as one.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import made, settings, shared_dir, small_batches, stored

SPACE = "▁"
#: Units of more code points don't fit the fold's state.
LONGEST_UNIT = 60
#: Units in a task of the lattice, on average.
UNITS = 20_000
#: Distinct units a task gathers before it sends them on.
GATHERED = 300_000
#: A slice of a file ends with the batch after which so many units (counted once each time they are sent on) were gathered for it.
SLICE_UNITS = 600_000


@dataclass(frozen=True)
class Vocabulary:
    """A piece table: texts and scores by id, and the id of byte 0 (ids of all bytes follow each other)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    special: frozenset[int]  # control, unknown and byte pieces: never in a text
    byte_0: int

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if i not in self.special}

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p in self.ids)


@lru_cache
def vocabulary(path: str) -> Vocabulary:
    """The piece table of a SentencePiece model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.get_piece_size())
    special = frozenset(i for i in n if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    return Vocabulary(tuple(model.id_to_piece(i) for i in n), tuple(model.get_score(i) for i in n), special, model.piece_to_id("<0x00>"))


def unit_pattern(vocab: Vocabulary) -> str:
    """A pattern whose matches tile a text such that no piece reaches from one into the next."""
    moved: set[str] = set()

    def kind(c: str) -> str:
        if c == SPACE:
            return "_"
        return "P" if c in moved or c == "_" or not re.match(r"\w", c) else "N" if re.match(r"\d", c) else "L"

    pairs = {(a, b) for p in vocab.ids for a, b in zip(p, p[1:], strict=False) if b != SPACE}
    if any(b == SPACE and a != SPACE for p in vocab.ids for a, b in zip(p, p[1:], strict=False)):
        return r"(?s).+"
    for _ in range(4):
        crossing = {(a, b) for a, b in pairs if a != SPACE and (kind(a) != kind(b) or kind(a) == "N")}
        if not crossing:
            own = "".join(map(re.escape, sorted(moved)))
            return rf"{SPACE}*[^\W\d_{SPACE}{own}]+|{SPACE}*(?:[^\w{SPACE}]|[_{own}])+|{SPACE}*\d|{SPACE}+"
        moved |= {c for a, b in crossing for c in (a, b) if kind(c) != "P"}
    return rf"{SPACE}*[^{SPACE}]+|{SPACE}+"


def marked(text: str) -> str:
    """The text as the model sees it: a mark in front and for each space; nothing for an empty text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def single_spaced(texts: pa.Array) -> pa.Array:
    """Whether a text is words between single spaces: each with a mark in front tiles into the same units as in its text."""
    return pc.invert(pc.or_(pc.or_(pc.equal(pc.binary_length(texts), 0), pc.starts_with(texts, " ")), pc.match_substring(texts, "  ")))


def _list(column: pa.Array) -> list:
    """A column without nulls as a list, several times as fast as to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> pa.ListArray:
    return pc.split_pattern(texts, " ")


# ---------------------------------------------------------------- folds over lattices


def spans(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit, start, end and the columns of pieces (piece, ...) for each substring of two code points or more of a unit that is a piece. pieces is a vocabulary and is broadcast. One unit's rows are in one partition, and partitions are small: a unit grows into some fifty substrings, and the groups of a task are held at once."""
    n = F.length("unit")
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // UNITS))
    starts = units.select("unit").repartition(tasks, "unit").where(n > 1).select("unit", F.explode(F.sequence(F.lit(0), n - 2)).alias("start"))
    sized = starts.select("unit", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), n - F.col("start")))).alias("size"))
    return sized.select("unit", "start", (F.col("start") + F.col("size")).alias("end"), F.substring("unit", F.col("start") + 1, F.col("size")).alias("piece")).join(F.broadcast(pieces), "piece")


def _shifted(value: Column | int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long") if isinstance(value, int) else value, by)


def edges(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit, edges, odd: the spans of a unit as numbers (rank, start, end; 6 bits each for start and end), better ranks first and then from left to right, and whether one of them is an odd piece. pieces: piece, rank, odd."""
    edge = _shifted(F.col("rank").cast("long"), F.lit(12)) + _shifted(F.col("start").cast("long"), F.lit(6)) + F.col("end")
    return spans(units, pieces, longest).groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.bool_or("odd").alias("odd"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it stands in it (also within lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _masks(edge: Column) -> tuple[Column, Column]:
    """The bounds at an edge's ends, and those strictly inside."""
    low, high = _shifted(1, F.shiftright(edge, 6).bitwiseAND(63).cast("int")), _shifted(1, edge.bitwiseAND(63).cast("int"))
    return low.bitwiseOR(high), high - low - low


def _whole(n: Column) -> Column:
    return _shifted(1, n + 1) - 1


def merges_in_order(lattice: Column, n: Column) -> Column:
    """The bounds (bit k: before code point k, bit n: the end) of byte-pair merging in one pass over the edges by rank.

    An edge merges if two neighbouring symbols make it up when its turn comes.
    A merge can only make a better one possible afterwards if some piece, taken
    alone, is not merged to itself in such a pass, or if ranks tie: symbols only
    grow, so at its turn the span of a piece was already closed off. Units with
    such odd pieces are for ``merges``.
    """

    def step(bounds: Column, edge: Column) -> Column:
        ends, inside = _masks(edge)
        joins = (bounds.bitwiseAND(ends) == ends) & (F.bit_count(bounds.bitwiseAND(inside)) == 1)
        return F.when(joins, bounds.bitwiseAND(F.bitwise_not(inside))).otherwise(bounds)

    return F.aggregate(lattice, _whole(n), step)


def merges(lattice: Column, n: Column) -> Column:
    """The bounds of byte-pair merging with any pieces: again and again the best edge is taken that joins two neighbouring symbols. Edges with an end inside a symbol are dropped on the way."""

    def alive(bounds: Column, edge: Column) -> Column:
        ends, inside = _masks(edge)
        return (bounds.bitwiseAND(ends) == ends) & (bounds.bitwiseAND(inside) != 0)

    def step(state: Column, _: Column) -> Column:
        def merged(best: Column) -> Column:
            bounds = state["bounds"].bitwiseAND(F.bitwise_not(_masks(best)[1]))
            return F.when(best.isNull(), F.struct(state["bounds"].alias("bounds"), F.slice(state["left"], 1, 0).alias("left"))).otherwise(F.struct(bounds.alias("bounds"), F.filter(state["left"], lambda e: alive(bounds, e)).alias("left")))

        return _let(F.get(F.filter(state["left"], lambda e: F.bit_count(state["bounds"].bitwiseAND(_masks(e)[1])) == 1), F.lit(0)), merged)

    return F.aggregate(F.sequence(F.lit(2), n), F.struct(_whole(n).alias("bounds"), lattice.alias("left")), step)["bounds"]


def viterbi(lattice: Column, n: Column, single: Column) -> Column:
    """The bounds of the path of greatest score; ``single`` is the array of the scores of single code points. Of equal paths the one whose last piece starts first wins at each end."""

    def step(nodes: Column, end: Column) -> Column:
        alone = F.struct((F.get(nodes, end - 1)["score"] + F.get(single, end - 1)).alias("score"), (-(end - 1)).alias("from"))
        here = F.transform(F.filter(lattice, lambda e: e["end"] == end), lambda e: F.struct((F.get(nodes, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("from")))
        bound = F.call_function("shiftleft", F.lit(1).cast("long"), end)
        return F.concat(nodes, F.array(_let(F.array_max(F.concat(here, F.array(alone))), lambda best: F.struct(best["score"].alias("score"), F.get(nodes, -best["from"])["bounds"].bitwiseOR(bound).alias("bounds")))))

    first = F.array(F.struct(F.lit(0.0).cast("double").alias("score"), F.lit(1).cast("long").alias("bounds")))
    return F.get(F.aggregate(F.sequence(F.lit(1), n), first, step), n)["bounds"]


def merged_in_python(unit: str, vocab: Vocabulary, ids: dict[str, int]) -> list[int]:
    """Byte-pair merging of one unit with a queue: the same as ``merges`` for units of any length."""
    n = len(unit)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    ends = list(range(1, n + 1))
    queue: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (i := ids.get(unit[a : ends[b]])) is not None and ends[b] - a <= vocab.longest:
            heapq.heappush(queue, (-vocab.scores[i], a, ends[b]))

    for a in range(n):
        offer(a)
    while queue:
        _, a, end = heapq.heappop(queue)
        b = after[a]
        if not alive[a] or b >= n or ends[b] != end:
            continue
        alive[b] = False
        ends[a], after[a] = end, after[b]
        if after[a] < n:
            before[after[a]] = a
            offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        piece = unit[a : ends[a]]
        out += [ids[piece]] if piece in ids else [vocab.byte_0 + x for x in piece.encode()]
        a = after[a]
    return out


def viterbi_in_python(unit: str, vocab: Vocabulary, ids: dict[str, int], unknown: float) -> list[int]:
    """The ids of the path of greatest score with back pointers: the same as ``viterbi`` for units of any length."""
    score, back = [0.0], [0]
    for end in range(1, len(unit) + 1):
        edges = [(score[a] + (vocab.scores[i] if (i := ids.get(unit[a:end])) is not None else unknown), -a) for a in range(max(0, end - vocab.longest), end) if a == end - 1 or unit[a:end] in ids]
        best, start = max(edges)
        score.append(best)
        back.append(-start)
    out, end = [], len(unit)
    while end:
        piece = unit[back[end] : end]
        out.append([ids[piece]] if piece in ids else [vocab.byte_0 + x for x in piece.encode()])
        end = back[end]
    return [i for part in reversed(out) for i in part]


def ranked(vocab: Vocabulary) -> list[tuple[str, int, bool]]:
    """piece, rank, odd of the pieces of two code points or more: their place by score (equal scores share one), and whether one pass over the edges by rank might not do for them."""
    longer = [p for p in vocab.ids if len(p) > 1]
    place = {score: k for k, score in enumerate(sorted({vocab.scores[vocab.ids[p]] for p in longer}, reverse=True))}
    rank = {p: place[vocab.scores[vocab.ids[p]]] for p in longer}
    held = Counter(rank.values())

    def bounds(piece: str) -> int:
        n = len(piece)
        state = (2 << n) - 1
        for _, a, b in sorted((rank[piece[a:b]], a, b) for a in range(n - 1) for b in range(a + 2, n + 1) if piece[a:b] in rank):
            ends, inside = 1 << a | 1 << b, (1 << b) - (2 << a)
            if state & ends == ends and (state & inside).bit_count() == 1:
                state &= ~inside
        return state

    return [(p, rank[p], held[rank[p]] > 1 or bounds(p) != 1 | 1 << len(p)) for p in longer]


def cut_ids(units: list[str], bounds: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units one after another, and where each unit's begin (and the last one's end); bounds: 64-bit masks, 0 where a unit is to have none."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    rows, at = np.nonzero(np.unpackbits(bounds.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at = at + (np.cumsum(sizes) - sizes)[rows]
    inner = rows[1:] == rows[:-1]
    text, find = "".join(units), vocab.ids.get
    cuts = list(zip(at[:-1][inner].tolist(), at[1:][inner].tolist(), strict=True))
    ids = np.array([find(text[a:b], -1) for a, b in cuts], np.int32)
    width = np.ones(ids.size, np.int64)
    missing = np.flatnonzero(ids < 0).tolist()
    spelled = [text[slice(*cuts[k])].encode() for k in missing]
    width[missing] = [len(x) for x in spelled]
    of_unit = np.bincount(rows[1:][inner], weights=width, minlength=len(units)).astype(np.int64)
    begin = np.cumsum(width) - width
    ids = np.repeat(ids, width)
    for k, x in zip(missing, spelled, strict=True):
        ids[begin[k] : begin[k] + len(x)] = vocab.byte_0 + np.frombuffer(x, np.uint8).astype(np.int32)
    return ids, np.concatenate([[0], np.cumsum(of_unit)])


def unit_ids(units: DataFrame, vocab: Vocabulary, *, fold: str = "merges", unknown: float = -1e6, packed: bool = False) -> DataFrame:
    """unit, ids (array of int; if packed, their little-endian bytes) of distinct units (no empty ones), and the other columns of units. Spans without a piece are single code points and become bytes; ``unknown`` is their score in the Viterbi fold."""
    spark = units.sparkSession
    n = F.length("unit")
    short = units.where(n <= LONGEST_UNIT)
    if fold == "merges":
        lattice = edges(short, spark.createDataFrame(ranked(vocab), "piece string, rank int, odd boolean"), vocab.longest)
        bounds = F.when(F.col("odd"), merges(F.col("edges"), n)).otherwise(merges_in_order(F.col("edges"), n))
    else:
        table = spark.createDataFrame([(p, float(vocab.scores[i])) for p, i in vocab.ids.items() if len(p) > 1], "piece string, score double")
        lattice = spans(short, table, vocab.longest).groupBy("unit").agg(F.collect_list(F.struct("score", "start", "end")).alias("edges"))
        letters = spark.createDataFrame([(p, float(vocab.scores[i])) for p, i in vocab.ids.items() if len(p) == 1], "letter string, letter_score double")
        alone = short.select("unit", F.posexplode(F.split("unit", ""))).where("col <> ''").join(F.broadcast(letters), F.col("col") == F.col("letter"), "left")
        alone = alone.groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("letter_score", F.lit(unknown)).alias("s")))), lambda x: x["s"]).alias("single"))
        lattice = alone.join(lattice, "unit", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<score:double,start:int,end:int>>)")))
        bounds = viterbi(F.col("edges"), n, F.col("single"))
    folded = lattice.select("unit", bounds.alias("bounds"))
    # units of one code point, or too long for a fold, have no bounds yet
    others = [c for c in units.columns if c != "unit"]
    folded = units.join(folded, "unit", "left").select("unit", "bounds", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _list(batch.column(0))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            long = np.flatnonzero(sizes > LONGEST_UNIT).tolist()
            bounds = np.where(batch.column(1).is_null().to_numpy(zero_copy_only=False), np.left_shift(2, np.minimum(sizes, LONGEST_UNIT)) - 1, batch.column(1).fill_null(0).to_numpy())
            bounds[long] = 0
            ids, begin = cut_ids(texts, bounds, vocab)
            if long:
                found = np.split(ids, begin[1:-1])
                for k in long:
                    found[k] = np.array(merged_in_python(texts[k], vocab, vocab.ids) if fold == "merges" else viterbi_in_python(texts[k], vocab, vocab.ids, unknown), np.int32)
                ids, begin = np.concatenate(found), np.cumsum([0, *map(len, found)])
            if packed:
                column = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((begin * 4).astype(np.int32)), pa.py_buffer(ids.astype("<i4"))])
            else:
                column = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, *batch.columns[2:]], names=["unit", "ids", *others])

    kinds = dict(units.dtypes)
    return folded.mapInArrow(run, ", ".join(["unit string", f"ids {'binary' if packed else 'array<int>'}", *(f"{c} {kinds[c]}" for c in others)]))


# ---------------------------------------------------------------- texts


def read_in_place(docs: DataFrame) -> bool:
    """Whether docs are the rows of Parquet files as they stand there: each row knows its file and number, and a task reads them in order."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation"):
        return False
    try:
        return bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:  # files of another kind have no row numbers
        return False


def encode(docs: DataFrame, path: str, *, fold: str = "merges") -> DataFrame:
    """doc_id, text, ids (little-endian int32 bytes) of documents (doc_id, text) of a model file: a BPE model, or a unigram model with fold ``viterbi``."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    vocab = vocabulary(path)
    pattern = unit_pattern(vocab)
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")]
    if not read_in_place(docs):
        docs = stored(docs.select(*kept))
    # where a row stands: the file, the part of it that one task reads at a stretch, and the row's number in the file
    rows = docs.select(*kept, F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("block"), F.col("_metadata.row_index").alias("row"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        words: dict[tuple[int, int], set[str]] = {}  # distinct words part into units once
        held: dict[tuple[int, int], set[str]] = {}
        stretch, piece, sent, last = None, (0, 0), 0, -1

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal sent
            for key, found in words.items():
                into = held.setdefault(key, set())
                for word in found:
                    into.update(find(SPACE + word))
            for (file, start), units in held.items():
                sent += len(units) if (file, start) == piece else 0
                listed = sorted(units)  # compresses better on its way
                for at in range(0, len(listed), 50_000):
                    part = listed[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.int64()), pa.array([start] * len(part), pa.int64()), pa.array(part, pa.string())], names=["file", "start", "unit"])
            words.clear()
            held.clear()

        for batch in batches:
            first: list[tuple[int, tuple[int, int]]] = []  # the batch's rows where another slice begins
            for k, (file, block, row) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                if (file, block) != stretch or (sent >= SLICE_UNITS and row > last):
                    stretch, piece, sent = (file, block), (file, row), 0
                if not first or first[-1][1] != piece:
                    first.append((k, piece))
                last = row
            for (k, key), end in zip(first, [x for x, _ in first[1:]] + [batch.num_rows], strict=True):
                texts = batch.column(0).slice(k, end - k)
                plain = single_spaced(texts)
                words.setdefault(key, set()).update(_list(split_words(texts.filter(plain)).flatten().unique()))
                for text in texts.filter(pc.invert(plain)).to_pylist():
                    held.setdefault(key, set()).update(find(marked(text)))
            if sum(map(len, held.values())) + sum(map(len, words.values())) > GATHERED:
                yield from out()
        yield from out()

    pairs = rows.select("text", "file", "block", "row").mapInArrow(collect, "file long, start long, unit string")
    root = made(shared_dir(spark) + "-units")
    # groups of a task of either aggregation are few enough to be held without sorting
    with settings(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(4 * UNITS)}):
        held = stored(pairs.repartition("unit").groupBy("unit").agg(F.collect_set(F.struct("file", "start")).alias("slices")))
        lines = unit_ids(held, vocab, fold=fold, packed=True).select("unit", "ids", F.explode("slices").alias("slice")).select("unit", "ids", "slice.*")
        lines.repartition("file", "start").write.partitionBy("file", "start").parquet(root)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        import pyarrow.parquet as pq

        find, store, base = re.compile(pattern).findall, *fs.FileSystem.from_uri(root)
        at, file_at, known, ids_of = None, None, pa.array([], pa.string()), pa.array([], pa.large_binary())
        starts: list[int] = []  # of the slices of the file at hand

        def listed(folder: str) -> list:
            return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))

        def load(file: int, start: int) -> None:
            nonlocal at, known, ids_of
            parts = [pq.read_table(f, columns=["unit", "ids"]) for x in listed(f"{base}/file={file}/start={start}") if x.path.endswith(".parquet") for f in [store.open_input_file(x.path)]]
            whole = pa.concat_tables(parts).combine_chunks() if parts else None
            known = whole.column(0).combine_chunks() if whole else pa.array([], pa.string())
            ids_of = whole.column(1).combine_chunks().cast(pa.large_binary()) if whole else pa.array([], pa.large_binary())
            at = (file, start)

        def joined(lists: list[list[str]]) -> pa.Array:
            """The ids of lists of units, one after another."""
            place = pc.index_in(pa.array([u for x in lists for u in x], pa.string()), value_set=known)
            if place.null_count:
                raise KeyError(f"units are missing from the slice {at}")
            taken = ids_of.take(place)
            ends = np.cumsum([0, *map(len, lists)])
            bounds = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[ends] if len(taken) else np.zeros(len(ends), np.int64)
            return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds), taken.buffers()[2] or pa.py_buffer(b"")])

        def of_texts(texts: pa.Array) -> list[bytes]:
            """The ids of texts of one slice: words that part at single spaces are looked up once a batch."""
            plain = single_spaced(texts)
            split = split_words(texts.filter(plain))
            coded = split.flatten().dictionary_encode()
            words = pc.binary_join_element_wise(pa.scalar(SPACE), coded.dictionary, pa.scalar(""))
            place = pc.index_in(words, value_set=known)  # most words are one unit
            absent = place.is_null()
            ids = pa.concat_arrays([ids_of.take(place.drop_null()), joined(list(map(find, _list(words.filter(absent)))))])
            is_absent = absent.to_numpy(zero_copy_only=False)
            order = np.empty(len(words), np.int64)
            order[np.flatnonzero(~is_absent)] = np.arange(len(words) - absent.true_count)
            order[np.flatnonzero(is_absent)] = np.arange(len(words) - absent.true_count, len(words))
            ids = ids.take(pa.array(order[coded.indices.to_numpy()]))
            bounds = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
            cuts, data = bounds[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist(), ids.buffers()[2]
            of_plain = iter([data[a:b].to_pybytes() if b > a else b"" for a, b in zip(cuts, cuts[1:], strict=False)])
            others = iter(joined([find(marked(x)) for x in texts.filter(pc.invert(plain)).to_pylist()]).to_pylist())
            return [next(of_plain) if x else next(others) for x in plain.to_pylist()]

        for batch in batches:
            made, begin, slices = [], 0, []
            for file, row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if file != file_at:
                    starts, file_at = sorted(int(x.base_name.removeprefix("start=")) for x in listed(f"{base}/file={file}")), file
                k = bisect_right(starts, row) - 1
                slices.append((file, starts[k] if k >= 0 else -1))  # before the first slice with units are only empty texts
            while begin < len(slices):
                end = begin + next((k for k, x in enumerate(slices[begin:]) if x != slices[begin]), len(slices) - begin)
                if slices[begin] != at:
                    load(*slices[begin])
                made += of_texts(batch.column(1).slice(begin, end - begin))
                begin = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc_id", "text", "ids"])

    return rows.select("doc_id", "text", "file", "row").mapInArrow(assemble, "doc_id long, text string, ids binary")


def piece_bytes(vocab: Vocabulary) -> list[bytes]:
    """What each id stands for."""
    out = [p.replace(SPACE, " ").encode() for p in vocab.pieces]
    for b in range(256):
        out[vocab.byte_0 + b] = bytes([b])
    for i in vocab.special:
        if not vocab.byte_0 <= i < vocab.byte_0 + 256:
            out[i] = b""
    return out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the text that its ids stand for."""
    small_batches(encoded.sparkSession)
    vocab = vocabulary(path)
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(piece_bytes(vocab), pa.large_binary())
        for batch in batches:
            ids = _list(batch.column(at))
            text = pieces.take(pa.array(np.frombuffer(b"".join(ids), "<i4")))
            bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist() if len(text) else [0] * (len(ids) + 1)
            found = [text.buffers()[2][a:b].to_pybytes().decode(errors="replace").removeprefix(" ") if b > a else "" for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit("")).schema)
