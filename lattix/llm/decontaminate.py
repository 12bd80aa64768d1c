"""Operator 2, benchmark decontamination by template canonicalisation.

Words of documents and benchmark items are stripped of punctuation and lower-cased, and numbers (in digits or words),
names and units become typed placeholders that remember what they stood for, their slots. Words are read in two ways, as a
capital at the beginning of a sentence tells little: names are words with a capital that don't begin a sentence, or words
with a capital that aren't common openers of sentences; a window of an item matches if it does in either. Every window of `width` template words of an item, and the whole of an item that is shorter, is
hash-joined with the same windows of the documents: executors drop windows outside a filter of the benchmark's windows
(false hits only cost a row), then the join is a join of two tables, of which Spark picks the form by size. A window that
more than `COMMON` items share is joined only where the document and the item already met in a rarer one, unless so many
of an item's windows are common that a match needn't have a rarer one.

For each document and item, the slots that matched are checked for consistency, each version of the item that the document
may hold by itself (matches whose places in the document and the item differ by about the same): one value of the item
must stand for one value of the document, and no two values of a kind for the same one. Which, the votes decide. Windows
that match under that substitution count for the item, windows that match but contradict it count against it, and their
difference, as a share of the item's windows, decides; `reparameterised` says that some slot's value differs. So a
question with other names, numbers and units is caught, and a passage whose shape only happens to agree isn't.

Windows without any literal word don't count unless an item has no others. Nulls and edges: null or wordless texts and
items of fewer than `FEWEST` template words match nothing; rows with a null id are left out, and rows that repeat an id
count as one document (one item), any of whose versions may match. Texts of any length are read in whole. Empty tables
give an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_of, scoped, slices, written
from .words import Words, groups, windows

# Words that stand for numbers, and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees kph mph watt watts volt volts joule joules newton newtons meter meters metre metres centimeter centimeters kilometer kilometers".split()
# Words that begin sentences without being names.
OPENERS = "a about above according add after again all almost along already also although always among an and another any anyone are as ask assume at away back based be because become before begin being below between both bring but by calculate call can check choose come compare complete compute consider could count describe despite determine did do does draw during each early either else enough estimate even eventually every everyone everything evaluate except explain express few figure fill finally find first following for from further generally get give given go had half has have he hence her here hers him his how however i if imagine in indeed initially inside instead into is it its itself just keep know last lastly later least less let like likewise list look made make many maybe meanwhile more most much multiply my name near neither never nevertheless next no nobody none nor not note nothing now of off often on once one only or other others otherwise our out outside over overall own part perhaps please prove put rather read recall round same say see several shall she should show simplify since so solve some someone something sometimes soon state still subtract such suppose take tell than that the their them then there therefore these they think this those though through throughout thus to today together tomorrow tonight too toward under unless unlike until up upon us use using usually was we well were what whatever when whenever where whereas whether which while who whoever whom whose why with within without work would write yes yesterday yet you your".split()
LITERAL, NUM, NAME, UNIT = range(4)
#: Template words that an item must have; items that may share a window before it is common; words by which places may shift within a version.
FEWEST, COMMON, SHIFT = 5, 64, 3
MARKS = np.array([0, 0x1D5C3A7E9B24F681, 0x2E6B4F8D1C35A792, 0x3F7A5E9C2D46B8A3], np.uint64)


def _bytes(s: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(s)] = True
    return out


_EDGE, _END, _DIGIT, _NUMERIC = _bytes(b"\"'`.,;:!?()[]{}<>*"), _bytes(b".!?:"), _bytes(b"0123456789"), _bytes(b"0123456789.,:/%+-$")


def _counted(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def _fixed(words: list[str]) -> np.ndarray:
    w = Words([" ".join(words).encode()])
    return np.sort(w.hashes(w.starts, w.ends))


_FIXED: dict[str, np.ndarray] = {}


def _among(h: np.ndarray, name: str, words: list[str]) -> np.ndarray:
    if name not in _FIXED:
        _FIXED[name] = _fixed(words)
    known = _FIXED[name]
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Templates(Words):
    """The template words of several whole texts: kinds and hashes of each reading, byte bounds a and b, and where each text's words begin (first).

    Letters are those of ASCII and Latin-1 where case matters. Words of punctuation alone are left out.
    """

    def __init__(self, texts: list[bytes]):
        super().__init__(texts)
        x = self.bytes
        low = x.copy()
        low[(x >= 65) & (x <= 90)] += 32
        edge, end, upper = _EDGE[x], _END[x], (x >= 65) & (x <= 90)
        if len(x) > 2:
            latin = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
            low[1:][latin] += 32
            upper[:-1] |= latin
            two = np.flatnonzero((x[:-1] == 0xC2) & ((x[1:] == 0xAB) | (x[1:] == 0xBB) | (x[1:] == 0xBF) | (x[1:] == 0xA1)))  # « » ¿ ¡
            three = np.flatnonzero((x[:-2] == 0xE2) & (x[1:-1] == 0x80) & (x[2:] >= 0x98))  # quotes, dots, bullets
            for at, n in ((two, 2), (three, 3)):
                for j in range(n):
                    edge[at + j] = True
            end[three[x[three + 2] == 0xA6]] = True  # …
        self.bytes, self.low = low, low
        inside = ~edge
        inside[x <= 32] &= ~np.isin(x[x <= 32], [9, 10, 11, 12, 13, 32])
        core = _counted(inside)
        at = np.append(np.flatnonzero(inside), len(x))
        ends_sentence = _counted(end)
        has = core[self.ends] > core[self.starts]
        a = at[np.minimum(core[self.starts], len(at) - 1)]
        b = np.where(has, at[np.maximum(core[self.ends] - 1, 0)] + 1, self.starts)
        stop = ends_sentence[self.ends] > ends_sentence[b]
        begins = np.ones(len(stop), bool)
        begins[1:] = stop[:-1]
        begins[self.first[:-1][self.first[:-1] < len(begins)]] = True
        kept = _counted(has)
        a, b, begins = a[has], b[has], begins[has]
        self.first = kept[self.first]
        h = self.hashes(a, b)
        digits, numeric = _counted(_DIGIT[x]), _counted(_NUMERIC[x])
        nd, rest = digits[b] - digits[a], (b - a) - (numeric[b] - numeric[a])
        number = (nd > 0) & (rest <= 2) & (_NUMERIC[x[a]] if len(a) else nd > 0) | _among(h, "number", NUMBER_WORDS)
        unit = _among(h, "unit", UNITS)
        capital = upper[a] if len(a) else nd > 0
        kinds = [np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, LITERAL))) for name in (capital & ~begins, capital & ~_among(h, "opener", OPENERS))]
        #: The kinds and hashes of each reading: no name begins a sentence; all words with a capital are names but openers.
        self.readings = [(k, np.where(k == LITERAL, h, MARKS[k])) for k in kinds]
        self.a, self.b = a, b

    def slots(self, at: int, wide: int, reading: int) -> list[str]:
        """What the placeholders of a window stand for, each led by its place and kind."""
        kinds = self.readings[reading][0][at : at + wide]
        return [f"{j}:{kinds[j]}:{self.low[self.a[at + j] : self.b[at + j]].tobytes().decode('utf-8', 'replace')}" for j in np.flatnonzero(kinds).tolist()]


_SCHEMA = "id long, hash long, window long, slots array<string>, literal boolean, place int, wide int, total int"


def _item_windows(benchmark: DataFrame, width: int, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, names = [], batch.column(0).to_pylist()
            for first, group in groups(batch.column(1).to_pylist()):
                t = Templates(group)
                for i, (a, b) in enumerate(zip(t.first[:-1].tolist(), t.first[1:].tolist())):
                    if b - a < FEWEST:
                        continue
                    wide = min(width, b - a)
                    own, also = [], []
                    first_reading, second = (windows(h[a:b], wide).view(np.int64).tolist() for _, h in t.readings)
                    for at, (x, y) in enumerate(zip(first_reading, second)):
                        s = t.slots(a + at, wide, 0)
                        window = xxhash.xxh3_64_intdigest(repr((x, s)).encode()) - (1 << 63)
                        own.append((x, window, s, len(s) < wide, at))
                        if y != x:
                            s = t.slots(a + at, wide, 1)
                            also.append((y, window, s, len(s) < wide, at))
                    some = any(o[3] for o in own)
                    own = [o for o in own if o[3] or not some]
                    counted = {o[1] for o in own}
                    # A window that counts may match in its second reading as well, unless that leaves no literal word.
                    also = [o for o in also if o[1] in counted and (o[3] or not some)]
                    out += [(names[first + i], *o, wide, len(counted)) for o in own + also]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "hash", "window", "slots", "literal", "place", "wide", "total"), o)) for o in out], pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("window", pa.int64()), ("slots", pa.list_(pa.string())), ("literal", pa.bool_()), ("place", pa.int32()), ("wide", pa.int32()), ("total", pa.int32())]))

    own = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text")).where("id is not null")
    return own.mapInArrow(run, _SCHEMA)


def _document_windows(docs: DataFrame, widths: list[int], wanted) -> DataFrame:
    """(doc_id, hash, at, values) of the windows that pass the filter, at their places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        those = wanted.value
        for batch in slices(batches):
            found, names = set(), batch.column(0).to_pylist()
            for first, group in groups(batch.column(1).to_pylist()):
                t = Templates(group)
                for wide, reading in ((w, r) for w in widths for r in (0, 1)):
                    own = windows(t.readings[reading][1], wide)
                    at = np.flatnonzero(those.test(own)) if len(own) else np.empty(0, np.int64)
                    text = np.searchsorted(t.first, at, "right") - 1
                    whole = at + wide <= t.first[np.minimum(text + 1, len(t.first) - 1)]
                    for j, i in zip(at[whole].tolist(), text[whole].tolist()):
                        found.add((names[first + i], int(own[j : j + 1].view(np.int64)[0]), j - int(t.first[i]), *t.slots(j, wide, reading)))
            out = [(f[0], f[1], f[2], list(f[3:])) for f in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.string()))], ["doc_id", "hash", "at", "values"])

    return docs.mapInArrow(run, "doc_id long, hash long, at int, values array<string>")


Match = tuple[int, int, list[str], list[str]]  # window, place in the document less place in the item, item's slots, document's slots


def versions(matches: list[Match]) -> list[list[Match]]:
    """The matches of each version of the item in the document: those of one shift, and those of shifts that follow each other closely."""
    by: dict[int, list[Match]] = {}
    for m in matches:
        by.setdefault(m[1], []).append(m)
    chains: list[list[int]] = []
    for shift in sorted(by):
        if chains and shift - chains[-1][-1] <= SHIFT:
            chains[-1].append(shift)
        else:
            chains.append([shift])
    return list(by.values()) + [[m for s in c for m in by[s]] for c in chains if len(c) > 1]


def consistent(matches: list[Match]) -> tuple[int, bool]:
    """For the version of the item that matches best: its windows that agree with one substitution, less those that contradict it, and whether it changes a value."""
    return max((_agreeing(v) for v in versions(matches)), key=lambda x: (x[0], not x[1]), default=(0, False))


def _agreeing(matches: list[Match]) -> tuple[int, bool]:
    votes: Counter = Counter()
    pairs = []
    for window, _, theirs, ours in matches:
        own = [(*a.split(":", 2)[1:], b.split(":", 2)[2]) for a, b in zip(theirs, ours)]
        pairs.append((window, own))
        votes.update(own)
    meant: dict[tuple[str, str], str] = {}
    taken: set[tuple[str, str]] = set()
    for kind, a, b in sorted(votes, key=lambda x: (-votes[x], x[1] != x[2], x)):
        if (kind, a) not in meant and (kind, b) not in taken:
            meant[kind, a] = b
            taken.add((kind, b))
    good = {window for window, own in pairs if all(meant.get((kind, a)) == b for kind, a, b in own)}
    against = {window for window, _ in pairs} - good
    return len(good) - len(against), any(a != b for (_, a), b in meant.items())


@scoped
def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.5, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, windows, matched, reparameterised) of every document and item of which at least `share` of the item's windows match."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where("doc_id is not null")
    read = written(_item_windows(benchmark, width, item_col))
    # An item's windows from the rarest on: one of the first `total` - ceil(share * `total`) + 1 is in every match.
    by_rarity = Window.partitionBy("item_id").orderBy("shared", "window")
    items = read.join(read.groupBy("hash").agg(F.count_distinct("id").alias("holders")), "hash").withColumnRenamed("id", "item_id")
    items = items.withColumn("shared", F.max("holders").over(Window.partitionBy("item_id", "window")))
    first = F.dense_rank().over(by_rarity) <= F.col("total") - F.ceil(F.lit(share) * F.col("total")) + 1
    items = written(items.withColumn("leads", first | (F.col("shared") <= COMMON)).select("item_id", "hash", "window", "place", "slots", "total", "leads", "wide"))
    widths = sorted(r[0] for r in items.select("wide").distinct().collect())  # `width` values at most
    bits = min(30, max(20, int(np.ceil(np.log2(16 * max(1, items.count()))))))
    wanted = spark.sparkContext.broadcast(bloom_of(items.select("hash"), bits))
    found = written(_document_windows(own, widths, wanted))
    both = ["doc_id", "item_id", "window", "total", (F.col("at") - F.col("place")).alias("shift"), "slots", "values"]
    leading = written(found.join(items.where("leads"), "hash").select(both))
    common = items.where("not leads").select("item_id", "hash", "window", "place", "slots", "total")
    met = leading.select("doc_id", "item_id").distinct()
    rest = found.join(common.select("hash").distinct(), "hash", "left_semi").join(met, "doc_id").join(common, ["item_id", "hash"]).select(both)
    pairs = leading.union(rest).groupBy("doc_id", "item_id").agg(F.max("total").alias("windows"), F.collect_set(F.struct("window", "shift", "slots", "values")).alias("matches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [consistent([(m["window"], m["shift"], m["slots"], m["values"]) for m in ms]) for ms in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.bool_())], ["doc_id", "item_id", "windows", "matched", "reparameterised"])

    return pairs.mapInArrow(run, "doc_id long, item_id long, windows int, matched int, reparameterised boolean").where(F.col("matched") >= F.lit(share) * F.col("windows"))


@scoped
def without_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.5) -> DataFrame:
    """docs without the contaminated rows; rows with a null id stay."""
    bad = contaminated(docs, benchmark, width, share).select(F.col("doc_id").alias("_contaminated")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_contaminated"], "left_anti")
