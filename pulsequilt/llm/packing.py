"""Packing of documents into fixed token sequences by cutting-stock column generation.

Documents become token ids once; every full sequence's worth is cut off, and
the remainders are packed. Their histogram of rounded lengths (at most
``CLASSES`` counts) is the demand of a cutting-stock linear program: patterns
are its columns, a knapsack dynamic program prices new ones, floors of the
solution are kept and the few left-over lengths form patterns of their own.
Documents, ranked within their length class, take the places of the patterns.

What patterns leave free is filled by a hashed share of the remainders, just
large enough by the program's own waste, that is cut freely; what is left of
it runs on into sequences without gaps, and the very last tokens into
sequences of powers of two, which need no padding.

Null texts are empty (their id count is one: the end id). Rows that repeat a
doc_id are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, stored, texts

SEQUENCE = 4096
#: Length classes of remainders; a class is SEQUENCE / CLASSES tokens wide.
CLASSES = 128
#: Words whose ids a worker remembers in each of two generations.
MEMO = 450_000
#: Hashed levels of remainders, some of which are cut to fill gaps.
LEVELS = 256
#: Width of the blocks in which gaps meet what fills them.
BLOCK = 8192
END_ID = 2


# ---------------------------------------------------------------- tokens


class Memo(dict):
    """Words' ids in two generations: a full one becomes the old one, from which words that still come are taken over. Letters before a full stop or comma, which is a token of its own, are looked up without it. Words in neither are noted in ``lacking``."""

    _PARTS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch

    def __init__(self, marks: dict[str, bytes]):
        super().__init__()
        self.marks = marks
        self.old: dict[str, bytes] = {}
        self.lacking: list[str] = []

    def parts(self, word: str) -> tuple[str, ...]:
        """What the word's ids are made of: letters and a run of ASCII marks behind them are tokens of their own."""
        m = None if word.isalpha() else self._PARTS(word)
        return m.groups() if m and m[1].lower().isalpha() else (word,)

    def __missing__(self, word: str) -> bytes | None:
        if ids := self.old.get(word):
            self[word] = ids
            return ids
        if mark := self.marks.get(word[-1:]):
            stem = word[:-1]
            if (ids := self.get(stem)) is None and (ids := self.old.get(stem)):
                self[stem] = ids
            if ids and stem[-1:].lower().isalpha():
                return ids + mark
        self.lacking.append(word)
        return None

    def age(self) -> None:
        self.old = dict(self)
        self.clear()


@lru_cache
def _word_tokenizer(path: str):
    """The tokenizer, what it remembers, and which ids end a word."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")
    mark = lambda m: np.array(tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes()
    return tokenizer, Memo({m: mark(m) for m in ".,"}), ends


#: Words given to the tokenizer at once, whose own records of a text take a hundred times its length.
TOGETHER = 4000


def _remember(need: list[str], tokenizer, memo: Memo, ends: np.ndarray) -> None:
    """Encodes words, those of letters some thousand in one go: each of these has one token with a word end, which tells them apart again."""
    all_letters = [w for w in need if w.isalpha()]
    for at in range(0, len(all_letters), TOGETHER):
        letters = all_letters[at : at + TOGETHER]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        cuts = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
        if len(cuts) == len(letters):
            data = ids.tobytes()
            memo.update(zip(letters, (data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
    rest = [w for w in need if w not in memo]
    for at in range(0, len(rest), TOGETHER):
        for w, e in zip(rest[at : at + TOGETHER], tokenizer.encode_batch_fast(rest[at : at + TOGETHER], add_special_tokens=False), strict=True):
            memo[w] = np.array(e.ids, "<u4").tobytes()


def word_ids(texts_: list[str], path: str, remembered: int = MEMO) -> list[bytes]:
    """Ids (little-endian uint32) of each text by a tokenizer that drops white space and never joins across it, so that words are encoded one by one and remembered; new words of all the texts are encoded in one go.

    Words part at spaces, tabs and line ends only, each of which the tokenizer
    counts as white space; what other white space a word holds is left to it.
    """
    tokenizer, memo, ends = _word_tokenizer(path)
    if len(memo) > remembered:
        memo.age()
    memo.lacking = []
    out = [list(map(memo.__getitem__, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts_]
    if lacking := memo.lacking:
        made = {w: memo.parts(w) for w in set(lacking)}
        _remember([x for x in {x for parts in made.values() for x in parts} if x not in memo], tokenizer, memo, ends)
        for w, parts in made.items():
            if w not in memo and w[-1] not in memo.marks:
                memo[w] = b"".join(map(memo.__getitem__, parts))
        late = iter([memo.get(w) or b"".join(map(memo.__getitem__, made[w])) for w in lacking])
        for ids in out:
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = next(late)
    return [b"".join(ids) for ids in out]


def token_rows(docs: DataFrame, path: str, sequence: int = SEQUENCE, classes: int = CLASSES, remembered: int = MEMO) -> DataFrame:
    """Pieces before packing: uid, doc_id, start, length, ids_crc32, doc_tokens, cls (0: a full sequence; else the remainder's length class) and the remainder's ids (uint16 or uint32), as a stored table."""

    def make():
        wide = _word_tokenizer(path)[0].get_vocab_size(with_added_tokens=True) > 65536
        uid = TaskContext.get().partitionId() << 40

        def run(x):
            nonlocal uid
            rows = []
            for doc_id, found in zip(x["doc_id"], word_ids(x["text"], path, remembered), strict=True):
                ids = np.frombuffer(found + END_ID.to_bytes(4, "little"), "<u4")
                for start in range(0, ids.size, sequence):
                    piece = ids[start : start + sequence]
                    whole = piece.size == sequence
                    rows.append((uid, doc_id, start, piece.size, zlib.crc32(piece.tobytes()), ids.size, 0 if whole else -(-piece.size * classes // sequence), None if whole else piece.astype("<u4" if wide else "<u2").tobytes()))
                    uid += 1
            return dict(zip(("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "ids"), zip(*rows, strict=True), strict=True))

        return run

    return stored(by_batch(texts(docs), make, "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, ids binary"))


# ---------------------------------------------------------------- cutting stock


def best_pattern(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: counts of each class (class w weighs w) of the dearest pattern within capacity, by dynamic programming."""
    weights = np.flatnonzero(price > 1e-12)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], 0
        fits = weights[weights <= c]
        if fits.size:
            v = best[c - fits] + price[fits]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], choice[c] = v[i], fits[i]
    counts, c = np.zeros(price.size, int), capacity
    while c > 0:
        if w := choice[c]:
            counts[w] += 1
            c -= w
        else:
            c -= 1
    return best[capacity], counts


def column_generation(demand: np.ndarray, capacity: int = CLASSES) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often each is used (not yet whole numbers) in the linear program of least sequences; demand[w] pieces of class w."""
    rows = np.flatnonzero(demand)
    basis = np.diag(capacity // rows).astype(float)
    use = demand[rows] / np.diag(basis)
    for _ in range(40 * rows.size):
        dual = np.linalg.solve(basis.T, np.ones(rows.size))
        price = np.zeros(demand.size)
        price[rows] = dual
        value, counts = best_pattern(price, capacity)
        if value <= 1 + 1e-9:
            break
        column = np.linalg.solve(basis, counts[rows].astype(float))
        up = column > 1e-9
        ratio = np.full(rows.size, np.inf)
        ratio[up] = use[up] / column[up]
        basis[:, int(ratio.argmin())] = counts[rows]
        use = np.maximum(np.linalg.solve(basis, demand[rows].astype(float)), 0)
    patterns = []
    for k in range(rows.size):
        p = np.zeros(demand.size, int)
        p[rows] = np.round(basis[:, k]).astype(int)
        patterns.append(p)
    return patterns, use


def whole_patterns(demand: np.ndarray, capacity: int = CLASSES) -> list[tuple[int, np.ndarray]]:
    """Patterns and whole multiplicities that hold each piece of the demand exactly once: the program's floors, then first fit by falling length for the rest."""
    if not demand.any():
        return []
    patterns, use = column_generation(demand, capacity)
    left, out = demand.copy(), []
    for p, x in zip(patterns, use, strict=True):
        fits = int(min((left[p > 0] // p[p > 0]).min(), np.floor(x + 1e-6)))
        if fits > 0:
            out.append((fits, p))
            left = left - fits * p
    bins: list[tuple[int, Counter]] = []
    for w in np.flatnonzero(left)[::-1].tolist():
        for _ in range(int(left[w])):
            k = next((k for k, (free, _) in enumerate(bins) if free >= w), None)
            if k is None:
                bins.append((capacity, Counter()))
                k = len(bins) - 1
            bins[k] = (bins[k][0] - w, bins[k][1] + Counter({w: 1}))
    for _, held in bins:
        p = np.zeros(demand.size, int)
        for w, n in held.items():
            p[w] = n
        out.append((1, p))
    return out


class Places:
    """Where the piece of a rank in its class goes."""

    def __init__(self, patterns: list[tuple[int, np.ndarray]]):
        self.sequences, taken, bases = 0, Counter(), {}
        for many, p in patterns:
            for w in np.flatnonzero(p).tolist():
                bases.setdefault(w, []).append((taken[w], int(p[w]), self.sequences))
                taken[w] += many * int(p[w])
            self.sequences += many
        self.bases = {w: np.array(b).T for w, b in bases.items()}

    def of(self, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(ranks.size, np.int64)
        for w in np.unique(classes).tolist():
            at = classes == w
            rank, each, first = self.bases[w]
            i = np.searchsorted(rank, ranks[at], side="right") - 1
            out[at] = first[i] + (ranks[at] - rank[i]) // each[i]
        return out


# ---------------------------------------------------------------- assignment


def _running(df: DataFrame, group: str, value: str, salts: int, key: str, to: str) -> tuple[DataFrame, dict]:
    """Adds, as ``to``, the sum of value over the rows of the same group before this one, in the order of (salt, key). A group is dealt to ``salts`` tasks, whose totals (groups times salts numbers) give their offsets. Also returns each group's total."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    totals = sorted(df.groupBy(group, "_salt").agg(F.sum(value)).collect())
    start, group_total = {}, Counter()
    for g, s, n in totals:
        start[g, s] = group_total[g]
        group_total[g] += n
    spark = df.sparkSession
    offsets = spark.createDataFrame([(g, s, n) for (g, s), n in start.items()], f"{group} {dict(df.dtypes)[group]}, _salt int, _start long")
    w = Window.partitionBy(group, "_salt").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_run", F.sum(value).over(w) - F.col(value)).join(F.broadcast(offsets), [group, "_salt"]).withColumn(to, F.col("_run") + F.col("_start")).drop("_run", "_start", "_salt"), group_total


def pack(docs: DataFrame, path: str, *, sequence: int = SEQUENCE, classes: int = CLASSES, remembered: int = MEMO) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``remembered`` bounds the words that a worker remembers (a generation; results don't depend on it)."""
    spark = docs.sparkSession
    salts = min(1024, max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = token_rows(docs, path, sequence, classes, remembered)

    # counts and tokens of the remainders by class and hashed level: at most CLASSES times LEVELS rows
    level = F.pmod(F.xxhash64("uid"), F.lit(LEVELS))
    counts, tokens = np.zeros((LEVELS, classes + 1), np.int64), np.zeros(LEVELS, np.int64)
    for c, k, n, t in rows.where("cls > 0").groupBy("cls", level.alias("level")).agg(F.count(F.lit(1)), F.sum("length")).collect():
        counts[k, c] = n
        tokens[k] += t
    # the levels below ``filling`` are cut: as few as fill what the patterns of the others leave free
    filling, patterns = 0, whole_patterns(counts.sum(axis=0), classes)
    while filling < LEVELS:
        waste = sum(m for m, _ in patterns) * sequence - int(tokens[filling:].sum())
        short = waste - int(tokens[:filling].sum())
        if short <= 0:
            break
        filling = min(LEVELS, filling + max(1, int(LEVELS * short / max(1, 2 * int(tokens.sum())))))
        patterns = whole_patterns(counts[filling:].sum(axis=0), classes)
    fills = level < filling
    # uid, doc_id, start, length, ids_crc32, doc_tokens, cls: -1 for what fills, 0 for full sequences
    light = rows.withColumn("cls", F.when((F.col("cls") > 0) & fills, -1).otherwise(F.col("cls"))).drop("ids")
    places = Places(patterns)
    n_items = places.sequences

    ranked, n_ranked = _running(light.where("cls >= 0").withColumn("one", F.lit(1)), "cls", "one", salts, "uid", "rank")

    def make():
        def run(x):
            cls, rank = np.array(x["cls"]), np.array(x["rank"], np.int64)
            at = np.where(cls > 0, 0, rank + n_items)
            at[cls > 0] = places.of(cls[cls > 0], rank[cls > 0])
            return {k: x[k] for k in ("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": at.tolist()}

        return run

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    placed = by_batch(ranked.drop("one"), make, f"uid long, {columns}")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stored(placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")))
    n_full = n_ranked.get(0, 0)

    # gaps of the patterns' sequences, and the stream that fills them
    gaps = placed.where(F.col("sequence_id") < n_items).groupBy("sequence_id").agg((F.lit(sequence) - F.sum("length")).alias("gap"), F.sum("length").alias("used")).where("gap > 0").withColumn("all", F.lit(0))
    gaps, gap_total = _running(gaps, "all", "gap", salts, "sequence_id", "g0")
    stream, stream_total = _running(light.where("cls = -1").withColumn("all", F.lit(0)), "all", "length", salts, "uid", "f0")
    g, f = gap_total.get(0, 0), stream_total.get(0, 0)
    blocks = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / BLOCK), F.floor((F.col(a) + F.col(n) - 1) / BLOCK)))
    low, high = F.greatest("f0", "g0"), F.least(F.col("f0") + F.col("length"), F.col("g0") + F.col("gap"))
    fill = stream.withColumn("block", blocks("f0", "length"))
    cuts = fill.join(gaps.select("sequence_id", "gap", "used", "g0", blocks("g0", "gap").alias("block")), "block").where((low < high) & (F.floor(low / BLOCK) == F.col("block")))
    in_gaps = cuts.select("uid", "doc_id", "doc_tokens", (low - F.col("f0")).alias("from"), (high - low).alias("n"), "sequence_id", (F.col("used") + low - F.col("g0")).alias("offset"))

    # what runs on behind the gaps: whole sequences, then powers of two
    rest = max(0, f - g)
    whole, end = divmod(rest, sequence)
    tail_at, base = whole * sequence, n_items + n_full
    tails, at = [], tail_at
    for bit in reversed(range(sequence.bit_length())):
        if end >> bit & 1:
            tails.append((at, 1 << bit, base + whole + len(tails)))
            at += 1 << bit
    p0, p1 = F.greatest(F.col("f0") - g, F.lit(0)), F.col("f0") + F.col("length") - g
    over = stream.where(p1 > 0).withColumn("p0", p0).withColumn("p1", p1)
    regular = over.where(F.col("p0") < tail_at).withColumn("k", F.explode(F.sequence(F.floor(F.col("p0") / sequence), F.floor((F.least("p1", F.lit(tail_at)) - 1) / sequence))))
    bins = regular.select("*", (F.col("k") * sequence).alias("b0"), F.lit(sequence).cast("long").alias("bn"), (F.col("k") + base).alias("sequence_id"))
    if tails:
        ends = spark.createDataFrame(tails, "b0 long, bn long, sequence_id long")
        bins = bins.drop("k").unionByName(over.where(F.col("p1") > tail_at).join(F.broadcast(ends), (F.col("p1") > F.col("b0")) & (F.col("p0") < F.col("b0") + F.col("bn"))))
    b_low, b_high = F.greatest("p0", "b0"), F.least(F.col("p1"), F.col("b0") + F.col("bn"))
    behind = bins.select("uid", "doc_id", "doc_tokens", (b_low + g - F.col("f0")).alias("from"), (b_high - b_low).alias("n"), "sequence_id", (b_low - F.col("b0")).alias("offset"))

    pieces = in_gaps.unionByName(behind).groupBy("uid", "doc_id", "doc_tokens").agg(F.sort_array(F.collect_list(F.struct("from", "n", "sequence_id", "offset"))).alias("cuts"))
    sources = rows.where((F.col("cls") > 0) & fills).select("uid", "start", "ids", F.length("ids").alias("n_bytes"), "length")
    cut = pieces.join(sources, "uid")

    def make_cut():
        def run(x):
            out = []
            for doc_id, tokens, cuts, start, ids, n_bytes, length in zip(*(x[k] for k in ("doc_id", "doc_tokens", "cuts", "start", "ids", "n_bytes", "length")), strict=True):
                ids = np.frombuffer(ids, f"<u{n_bytes // length}").astype("<u4")
                out += [(doc_id, start + c["from"], c["n"], zlib.crc32(ids[c["from"] : c["from"] + c["n"]].tobytes()), tokens, c["sequence_id"], c["offset"]) for c in cuts]
            return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), zip(*out, strict=True), strict=True))

        return run

    names = [c.split()[0] for c in columns.split(", ")] + ["offset"]
    return placed.select(*names).unionByName(by_batch(cut, make_cut, f"{columns}, offset long"))
