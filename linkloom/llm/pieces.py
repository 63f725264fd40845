"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut where no piece can reach across, so equal units are encoded once.
For each unit all substrings of bounded length are joined to the piece table. A
fold over the joined edges, by their end and for many units at once, keeps the best
path to each position (Viterbi). Scores add up as in a unigram model.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.base import by_batch, register, table

SPACE = "▁"
#: Units: spaces with what follows them, or runs of line feeds.
UNIT = rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+"
#: A vocabulary is broadcast; larger tables of pieces are refused.
MAX_PIECES = 1_000_000
#: Units that every worker knows: the most frequent ones of a sample of about so
#: many texts. Any choice is right, since all others take the join.
HEAD_UNITS, HEAD_TEXTS = 300_000, 20_000
HEAD_CHARS = 40
HEAD_PARTS = 48
#: Characters of one block, for which a dictionary of the other units is gathered.
BLOCK_CHARS = 8_000_000
#: Each block asks each part of the lattice in one row: parts for a block, at most so
#: many in all, unless each has more than so many blocks' share.
BLOCK_PARTS, MOST_PARTS, PART_BLOCKS = 3, 500, 20
#: Edges that are folded at once, and limits of the Arrow batches that bring them.
EDGES, EDGE_ROWS, EDGE_BYTES = 150_000, 20_000, "1m"
#: Longer units are cut where no piece reaches across.
CUT_CHARS = 512
CHUNK = 256
#: First characters of a substring that tell how long pieces are.
BEGIN = 3


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model file: text, score and id; ids of bytes, of unknown."""

    pieces: tuple[tuple[str, float, int], ...]
    bytes: tuple[int, ...]
    unknown: int
    size: int
    dummy_space: bool = True

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def unknown_score(self) -> float:
        return min(s for _, s, _ in self.pieces) - 10.0

    def expand(self, ids: list[int]) -> list[int]:
        """Code points without a piece (as -1 - code point) become their bytes."""
        if min(ids, default=0) >= 0:
            return ids
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def prepared(self, text: str | None) -> str:
        """Blanks as the space piece, one more in front of any text."""
        return (SPACE if self.dummy_space else "") + text.replace(" ", SPACE) if text else ""


def load_vocabulary(model_file: str | None = None) -> Vocabulary:
    """From a model file; by default the public one of 32,000 pieces."""
    import sentencepiece

    if model_file is None:
        import public_tokenizers

        model_file = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces; at most {MAX_PIECES} are broadcast")
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = tuple((model.id_to_piece(i), model.get_score(i), i) for i in plain)
    crossing = re.compile(rf"[^{SPACE}]{SPACE}|\n.|.\n", re.DOTALL)
    if any(crossing.search(p) for p, _, _ in pieces):
        raise ValueError("pieces reach across units")
    return Vocabulary(pieces, tuple(i for i in range(n) if model.is_byte(i)), model.unk_id(), n)


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    return spark.createDataFrame(list(vocabulary.pieces), "piece string, score double, id int")


def length_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """The lengths of pieces by their first characters; all lengths too short for these."""
    lengths: dict[str, set[int]] = {}
    for p, _, _ in vocabulary.pieces:
        if len(p) >= BEGIN:
            lengths.setdefault(p[:BEGIN], set(range(1, BEGIN))).add(len(p))
    return spark.createDataFrame([(p, sorted(n)) for p, n in lengths.items()], "begin string, lengths array<int>")


def edge_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, so that edges come many at a time and texts few."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(EDGE_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", EDGE_BYTES)


def edges_of(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Edges ``from``, ``to``, ``id`` of the lattice of each ``unit`` (not empty): a row for
    each substring that is a piece and for each single character that is none (there
    -1 - code point).

    Only substrings as long as some piece with their first characters are looked up.
    A unit's rows follow each other. Its first character's row, the first of them, has
    the unit and its other columns; the rest have nulls there. A long unit is first cut
    into overlapping chunks, so that taking substrings costs the same in any place.
    """
    longest = vocabulary.longest
    pieces = F.broadcast(piece_table(units.sparkSession, vocabulary).select("piece", "id"))
    kept = units.columns
    chunks = units.select(*kept, F.explode(F.sequence(F.lit(0), F.length("unit") - 1, F.lit(CHUNK))).alias("base")).withColumn(
        "chunk", F.substring("unit", F.col("base") + 1, F.lit(CHUNK + longest))
    )
    starts = chunks.select(*kept, "base", "chunk", F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK), F.length("chunk")) - 1)).alias("at"))
    begun = starts.withColumn("begin", F.substring("chunk", F.col("at") + 1, F.lit(BEGIN))).join(F.broadcast(length_table(units.sparkSession, vocabulary)), "begin", "left")
    ends = begun.select(*kept, "base", "chunk", "at", F.explode(F.coalesce("lengths", F.array(*[F.lit(k) for k in range(1, BEGIN)]))).alias("n"))
    spelt = ends.where(F.col("at") + F.col("n") <= F.length("chunk")).select(*kept, (F.col("base") + F.col("at")).alias("from"), "n", F.substring("chunk", F.col("at") + 1, F.col("n")).alias("piece"))
    joined = spelt.join(pieces, "piece", "left").where("id IS NOT NULL OR n = 1")
    first = (F.col("from") == 0) & (F.col("n") == 1)
    return joined.select(
        *[F.when(first, F.col(c)).alias(c) for c in kept], "from", (F.col("from") + F.col("n")).alias("to"), F.coalesce("id", -1 - F.ascii("piece")).alias("id")
    )


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions begin[k], ..., begin[k] + n[k] - 1, one k after the other."""
    ends = np.cumsum(n, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - n), n)


def _best_paths(vocabulary: Vocabulary, scores: np.ndarray, edges: pa.Table) -> pa.Table:
    """The units of ``edges`` with the ``ids`` of their best paths.

    All units advance together: round ``t`` takes the edges that end at position ``t``.
    Of equal paths the one with the earlier start of its last piece wins.
    """
    marked = edges.column("unit").is_valid().to_numpy()
    marks, owner = np.flatnonzero(marked), np.cumsum(marked) - 1
    start, to, ids = (edges.column(c).to_numpy().astype(np.int64) for c in ("from", "to", "id"))
    length = np.maximum.reduceat(to, marks)
    zero = np.cumsum(length + 1) - (length + 1)
    nodes, wide = int(zero[-1] + length[-1] + 1), vocabulary.longest + 1
    into = zero[owner] + to
    order = np.argsort((to * nodes + into) * wide + (vocabulary.longest - (to - start)))
    to, into, source, ids = to[order], into[order], (zero[owner] + start)[order], ids[order]
    score = np.where(ids >= 0, scores[np.maximum(ids, 0)], vocabulary.unknown_score)
    groups = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
    sizes = np.diff(np.append(groups, len(into)))
    rounds = np.arange(1, int(length.max()) + 2)
    bounds, lots = np.searchsorted(to, rounds), np.searchsorted(to[groups], rounds)
    best, taken = np.full(nodes, -np.inf), np.zeros(nodes, dtype=np.int64)
    best[zero] = 0.0
    for t in range(len(rounds) - 1):
        a, b, lot = bounds[t], bounds[t + 1], slice(lots[t], lots[t + 1])
        if a == b:
            raise ValueError("a unit's edges do not follow each other")
        reached = best[source[a:b]] + score[a:b]
        top = np.maximum.reduceat(reached, groups[lot] - a)
        best[into[groups[lot]]] = top
        hits = a + np.flatnonzero(reached == np.repeat(top, sizes[lot]))[::-1]
        taken[into[hits]] = hits  # the last assignment holds: the earliest start
    if not np.isfinite(best).all():
        raise ValueError("a unit's edges do not follow each other")
    alive, at, steps = np.arange(len(marks)), zero + length, []
    while len(alive):
        edge = taken[at]
        steps.append((alive, ids[edge]))
        on = source[edge] > zero[alive]
        alive, at = alive[on], source[edge][on]
    n = np.bincount(np.concatenate([x for x, _ in steps]), minlength=len(marks))
    ends = np.cumsum(n)
    path = np.zeros(int(ends[-1]), dtype=np.int64)
    for k, (units, step) in enumerate(steps):
        path[ends[units] - 1 - k] = step
    if path.min() < 0:
        spelt = [vocabulary.expand([i]) for i in path[path < 0].tolist()]
        times = np.ones(len(path), dtype=np.int64)
        times[path < 0] = [len(x) for x in spelt]
        n = np.add.reduceat(times, ends - n)
        path = np.repeat(path, times)
        path[path < 0] = [i for x in spelt for i in x]
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(path.astype(np.int32)))
    return edges.drop_columns(["from", "to", "id"]).take(pa.array(marks)).append_column("ids", made)


def _folded(vocabulary: Vocabulary):
    """Edges of whole units, as they come, as units with their ``ids``."""

    def run(batches):
        scores = np.zeros(vocabulary.size)
        for _, score, i in vocabulary.pieces:
            scores[i] = score
        held: list[pa.RecordBatch] = []
        rows, limit = 0, EDGES
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                edges = pa.Table.from_batches(held)
                last = int(np.flatnonzero(edges.column("unit").is_valid().to_numpy())[-1])  # this unit may go on
                if last:
                    yield _best_paths(vocabulary, scores, edges.slice(0, last).combine_chunks())
                held = edges.slice(last).combine_chunks().to_batches()
                rows = edges.num_rows - last
                limit = max(EDGES, 2 * rows)
        if rows:
            yield _best_paths(vocabulary, scores, pa.Table.from_batches(held).combine_chunks())

    return run


def _cut(unit: str, pieces: set[str], longest: int) -> list[str]:
    """``unit`` in parts, cut at positions that lie inside no piece. Every path passes
    these, so the parts' best paths make up the unit's."""
    n = len(unit)
    out, start, reach = [], 0, 0
    for at in range(n):
        if at > start and reach <= at:
            out.append(unit[start:at])
            start = at
        for end in range(min(n, at + longest), max(reach, at + 1), -1):
            if unit[at:end] in pieces:
                reach = end
                break
    return [*out, unit[start:]]


def _units_of(vocabulary: Vocabulary):
    pattern, longest = re.compile(UNIT), vocabulary.longest
    pieces: set[str] = set()

    def cut(units: list[str]) -> list[str]:
        if not pieces:
            pieces.update(p for p, _, _ in vocabulary.pieces)
        return [x for u in units for x in (_cut(u, pieces, longest) if len(u) > CUT_CHARS else [u])]

    def units(text: str | None) -> list[str]:
        if not text or text[0] == " " or "  " in text or "\n\n" in text or SPACE in text:
            return pattern.findall(vocabulary.prepared(text))
        # Blanks and line feeds stand alone: the same units, without the pattern.
        split = ((SPACE if vocabulary.dummy_space else "") + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")
        return [u for u in split if u] if "\n" in text else split

    return units, cut


def _pressed(numbers: np.ndarray, press) -> bytes:
    """Small numbers, their first bytes together, then the second ones and so on."""
    return press(np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpressed(data: bytes, unpress) -> np.ndarray:
    return np.frombuffer(unpress(data), dtype=np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(-1)


def _joined(units: list[str]) -> bytes:
    """No unit holds a space: spaces are written as the space piece."""
    return " ".join(units).encode("utf-8", "surrogatepass")


def _split(data: bytes) -> list[str]:
    return data.decode("utf-8", "surrogatepass").split(" ") if data else []


def _packed(vocabulary: Vocabulary, known):
    """Each text as numbers of known units, with 0 for others, and the others."""

    def run(batches):
        (units, cut), press = _units_of(vocabulary), zstandard.ZstdCompressor(level=3).compress
        number = known.value.get
        for batch in batches:
            numbers, others = [], []
            for text in batch.column("text").to_pylist():
                own = units(text)
                row = np.fromiter(map(number, own, repeat(0)), np.int32, len(own))
                rest = [own[k] for k in np.flatnonzero(row == 0).tolist()]
                if max(map(len, rest), default=0) > CUT_CHARS:  # known ones are short
                    own = cut(own)
                    row = np.fromiter(map(number, own, repeat(0)), np.int32, len(own))
                    rest = [own[k] for k in np.flatnonzero(row == 0).tolist()]
                numbers.append(_pressed(row, press))
                others.append(press(_joined(rest)))
            arrays = [batch.column("row"), batch.column("block"), pa.array(numbers, pa.binary()), pa.array(others, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "block", "numbers", "others"])

    return run


def _by_part(others: list[bytes], parts: int, unpress) -> dict[int, list[str]]:
    """Distinct units of a block's texts, in order, by the part of the lattice that they ask."""
    distinct: set[str] = set()
    for data in others:
        distinct.update(_split(unpress(data)))
    found: dict[int, list[str]] = {}
    for u in sorted(distinct):
        found.setdefault(zlib.crc32(u.encode("utf-8", "surrogatepass")) % parts, []).append(u)
    return found


def _asked(parts: int):
    """What the blocks of a partition ask of each part."""

    def run(batches):
        press, unpress = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        texts: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("others").to_pylist(), strict=True):
                texts.setdefault(block, []).append(data)
        for block in list(texts):
            found = _by_part(texts.pop(block), parts, unpress)
            arrays = [pa.array([*found], pa.int32()), pa.array([block] * len(found), pa.int32()), pa.array([press(_joined(u)) for u in found.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "units"])

    return run


def _gathered(batches):
    """Distinct units of a partition of the lattice, and who asks: block and place there."""
    unpress = zstandard.ZstdDecompressor().decompress
    asked: dict[tuple[int, str], list[int]] = {}
    for batch in batches:
        for part, block, units in zip(*[batch.column(c).to_pylist() for c in ("part", "block", "units")], strict=True):
            for place, u in enumerate(_split(unpress(units)), block << 32):
                asked.setdefault((part, u), []).append(place)
    keys = [*asked]
    for k in range(0, len(keys), EDGE_ROWS):
        some = keys[k : k + EDGE_ROWS]
        arrays = [pa.array([u for _, u in some], pa.string()), pa.array([p for p, _ in some], pa.int32()), pa.array([asked.pop(x) for x in some], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["unit", "part", "asked"])


def _answered(vocabulary: Vocabulary):
    """Best paths of a partition's units, a row for each block: ids in the order it asked."""
    fold = _folded(vocabulary)

    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        found = [x.drop_columns(["unit"]) for x in fold(batches)]
        if not found:
            return
        units = pa.concat_tables(found).combine_chunks()
        asked, ids = (units.column(c).combine_chunks() for c in ("asked", "ids"))
        owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
        places, part = asked.flatten().to_numpy(), units.column("part").to_numpy()[owner]
        order = np.lexsort((places, part))
        owner, part, block = owner[order], part[order], places[order] >> 32
        begin, n = ids.offsets.to_numpy()[:-1][owner], np.diff(ids.offsets.to_numpy())[owner]
        flat = ids.values.to_numpy()
        new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (part[1:] != part[:-1]))))
        rows: list[list] = [[], [], [], []]
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(block)], strict=True):
            made = int(block[a]), int(part[a]), _pressed(n[a:b], press), _pressed(flat[_spans(begin[a:b], n[a:b])], press)
            for row, x in zip(rows, made, strict=True):
                row.append(x)
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["block", "part", "sizes", "ids"])

    return run


def _unit_counts(vocabulary: Vocabulary):
    """Short units that a partition repeats, with their counts."""

    def run(batches):
        units, _ = _units_of(vocabulary)
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(u for u in units(text) if len(u) <= HEAD_CHARS)
        often = {u: n for u, n in counts.items() if n > 1}
        yield pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], names=["unit", "n"])

    return run


def frequent_units(docs: DataFrame, vocabulary: Vocabulary, rows: int) -> list[tuple[str, list[int]]]:
    """At most ``HEAD_UNITS`` short units that a sample of texts repeats, encoded; frequent ones first."""
    every = max(1, rows // HEAD_TEXTS)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(_unit_counts(vocabulary), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("times"))
    top = counts.orderBy(F.desc("times"), "unit").limit(HEAD_UNITS)
    fold = _folded(vocabulary)

    def paths(batches):
        for found in fold(batches):
            yield from found.to_batches()

    got = edges_of(top.repartition(HEAD_PARTS, "unit"), vocabulary).mapInArrow(paths, "unit string, times long, ids array<int>").toArrow()
    got = got.sort_by([("times", "descending"), ("unit", "ascending")])
    return list(zip(got.column("unit").to_pylist(), got.column("ids").to_pylist(), strict=True))


def encode(docs: DataFrame, vocabulary: Vocabulary, carry: list[str]) -> DataFrame:
    """``row`` (the carried columns) and ``ids`` for every row of ``docs``.

    Frequent units are known to every worker (a bounded dictionary, itself made by
    the lattice). Texts travel once, to blocks, as numbers of known units and the
    others. A block asks each part of the lattice for its distinct others, and gets
    their ids in the order asked; each unit is encoded once. Rows fall into blocks by
    their columns' hash, so a text that many rows copy is spread. Null and empty texts
    have no ids.
    """
    spark = docs.sparkSession
    edge_batches(spark)
    given = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row"), F.col("text").cast("string").alias("text"))
    size = given.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    rows, blocks = size.rows, max(1, -(-(size.chars or 0) // BLOCK_CHARS))
    given = given.withColumn("block", F.pmod(F.xxhash64("row", "text"), F.lit(blocks)).cast("int"))
    head = frequent_units(given, vocabulary, rows)
    known = spark.sparkContext.broadcast({u: k for k, (u, _) in enumerate(head, 1)})
    sizes = np.array([0, *[len(i) for _, i in head]], dtype=np.int32)
    known_ids = spark.sparkContext.broadcast((sizes, np.array([x for _, i in head for x in i], dtype=np.int32)))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(shuffled, BLOCK_PARTS * blocks), max(MOST_PARTS, blocks // PART_BLOCKS))
    kind = given.schema["row"].dataType.simpleString()
    packed = given.mapInArrow(_packed(vocabulary, known), f"row {kind}, block int, numbers binary, others binary")
    packed = packed.repartition(max(shuffled, blocks), "block")  # read twice, made once
    asked = packed.mapInArrow(_asked(parts), "part int, block int, units binary").repartitionById(parts, "part")
    units = asked.mapInArrow(_gathered, "unit string, part int, asked array<long>")
    answers = edges_of(units, vocabulary).mapInArrow(_answered(vocabulary), "block int, part int, sizes binary, ids binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor().decompress
        widths, flats = [known_ids.value[0]], [known_ids.value[1]]
        wanted = _by_part(left.column("others").to_pylist(), parts, unpress)
        own: dict[str, int] = {}
        first = len(widths[0])
        for part, sizes, ids in zip(*[right.column(c).to_pylist() for c in ("part", "sizes", "ids")], strict=True):
            widths.append(_unpressed(sizes, unpress))
            flats.append(_unpressed(ids, unpress))
            own.update(zip(wanted.pop(part), range(first, first + len(widths[-1])), strict=True))
            first += len(widths[-1])
        if wanted:
            raise ValueError("a part of the lattice did not answer")
        width, flat = np.concatenate(widths), np.concatenate(flats)
        begin = np.cumsum(width, dtype=np.int64) - width
        out, total = [], [0]
        for numbers, rest in zip(left.column("numbers").to_pylist(), left.column("others").to_pylist(), strict=True):
            row = _unpressed(numbers, unpress)
            spelt = _split(unpress(rest))
            if spelt:
                row[row == 0] = [own[u] for u in spelt]
            made = flat[_spans(begin[row], width[row])]
            out.append(made)
            total.append(total[-1] + len(made))
        joined = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.array(total, dtype=np.int32)), pa.array(joined, pa.int32()))
        return pa.table({"row": left.column("row"), "ids": ids})

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, f"row {kind}, ids array<int>")


def spelt(vocabulary: Vocabulary) -> list[bytes]:
    """What each id stands for in a text."""
    out = [b""] * vocabulary.size
    for piece, _, i in vocabulary.pieces:
        out[i] = piece.replace(SPACE, " ").encode("utf-8")
    for b, i in enumerate(vocabulary.bytes):
        out[i] = bytes([b])
    out[vocabulary.unknown] = " ⁇ ".encode()
    return out


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of ``ids``; what the model's own decoder gives for valid bytes.

    Pieces are looked up by position in one constant array of the vocabulary's
    size and joined as bytes, so byte pieces form characters again. One leading
    blank, which encoding added, is taken off. Null for null.
    """
    pieces = F.split(F.lit(",".join(x.hex() for x in spelt(vocabulary))), ",")
    joined = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "utf-8")
    return F.when(joined.startswith(" "), F.substring(joined, 2, F.length(joined))).otherwise(joined) if vocabulary.dummy_space else joined


def _round_trip(vocabulary: Vocabulary):
    """Decodes each row's ids as ``decode`` does and compares with the text's md5."""
    words, blank = spelt(vocabulary), vocabulary.dummy_space

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, same = batch.column("ids"), []
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        for k, want in enumerate(batch.column("row").field("sum").to_pylist()):
            back = b"".join([words[i] for i in flat[ends[k] : ends[k + 1]].tolist()])
            same.append(hashlib.md5(back[1:] if blank and back.startswith(b" ") else back).hexdigest() == want)
        return pa.RecordBatch.from_arrays([batch.column("row"), column, pa.array(same, pa.bool_())], names=["row", "ids", "round_trip"])

    return run


def round_trips(docs: DataFrame, vocabulary: Vocabulary, carry: list[str]) -> DataFrame:
    """``row`` (the carried columns), ``ids``, and ``round_trip``: whether decoding
    the ids gives the text back (by its md5, so that no text travels).

    A null text counts as empty. A space piece in the text comes back as a space:
    no round trip.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry]).alias("kept"), F.md5(text.cast("binary")).alias("sum"), "text")
    found = encode(own, vocabulary, ["kept", "sum"])
    kind = found.schema["row"].dataType.simpleString()
    found = found.mapInArrow(by_batch(_round_trip(vocabulary)), f"row {kind}, ids array<int>, round_trip boolean")
    return found.select(F.col("row.kept").alias("row"), "ids", "round_trip")


@register("op5_sentencepiece")
def piece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text back."""
    docs = table(spark, sf_dir, "documents")
    found = round_trips(docs, load_vocabulary(), ["doc_id"])
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
