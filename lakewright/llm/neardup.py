"""Near duplicates by SetSketch registers, banded, estimated jointly and verified on whole shingle sets."""

from __future__ import annotations

from dataclasses import dataclass


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import _ODD, Steps, keyed, lowered, mixed, rows_by_key, span_hashes, text_step, utf8, word_spans
from lakewright.llm.components import components
from lakewright.operators.windows import match

SHINGLE_WORDS = 5
#: Registers of a sketch; the first half is banded, all are estimated from.
REGISTERS = 480
#: Registers hold the rounded negative logarithm, to this base, of the least exponential value; one byte each.
BASE, RATE, TOP = 1.1, 20.0, 255
#: Larger buckets and families are dealt into blocks of about so many members and bytes, and block meets block.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Partners in most equal registers that a class verifies first.
FIRST_PARTNERS = 3
_FILTER_BITS = 1 << 24
_MULTIPLIERS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Likeness:
    """What counts as a link, and how candidates for it are found.

    A pair of similarity 0.85 agrees in no band with probability 6e-9, one of
    0.8 with probability 5e-9. A pair whose likeliest similarity lies more than
    ``slack`` below the link is none: that is five standard errors of the
    estimate, which come to 1.05 times those of as many plain minima.
    """

    percent: int = 85

    def __post_init__(self):
        if not 80 <= self.percent <= 100:
            raise ValueError("links are found for similarities of 80 to 100 percent")

    @property
    def rows(self) -> int:
        return 6 if self.percent >= 85 else 5

    @property
    def bands(self) -> int:
        return REGISTERS // 2 // self.rows

    @property
    def slack(self) -> float:
        j = self.percent / 100
        return 5.25 * (j * (1 - j) / REGISTERS) ** 0.5


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text (A-Z as a-z); none without words."""
    data, offsets = utf8(texts)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(lowered(data), starts, ends)
    sets = []
    with np.errstate(over="ignore"):
        weights = [mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(SHINGLE_WORDS)]
        n = len(words)
        whole = np.zeros(max(0, n - SHINGLE_WORDS + 1), np.uint64)
        for k, w in enumerate(weights if len(whole) else ()):
            whole += words[k:n - SHINGLE_WORDS + 1 + k] * w
        whole = mixed(whole)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                sets.append(np.unique(whole[a:b - SHINGLE_WORDS + 1]))
            elif b > a:
                few = sum((words[a + k:a + k + 1] * weights[k] for k in range(b - a)), np.zeros(1, np.uint64))
                sets.append(mixed(few + _ODD * np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set that has a shingle (rows of zeros for others); the larger register wins in a merge.

    The least of scattered hashes gives the least of exponential values, as
    both fall together, so values are computed from the least hash alone.
    """
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    some = [k for k, s in enumerate(sets) if len(s)]
    if not some:
        return out
    flat = np.concatenate([sets[k] for k in some])
    begin = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])])[:-1]
    least = np.empty((len(some), REGISTERS), np.uint64)
    with np.errstate(over="ignore"):
        scattered = np.empty_like(flat)
        for j, m in enumerate(_MULTIPLIERS):
            np.multiply(flat, m, out=scattered)
            scattered ^= scattered >> np.uint64(29)
            least[:, j] = np.minimum.reduceat(scattered, begin)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
    out[some] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint8)
    return out


def _agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where registers of the first are larger, smaller and equal, counted per pair of rows."""
    larger, smaller = np.count_nonzero(a > b, axis=1), np.count_nonzero(a < b, axis=1)
    return larger, smaller, a.shape[1] - larger - smaller


def _slope(j, counts: tuple, u: np.ndarray) -> np.ndarray:
    """Derivative by J of the likelihood's logarithm.

    With shares u and v of the set sizes, a register of the first is larger
    with probability p(u - vJ) and smaller with p(v - uJ), where
    p(x) = -log_b(1 - x (b - 1) / b). The likelihood has one peak in J.
    """
    larger, smaller, equal = counts
    v, rate = 1 - u, (BASE - 1) / BASE
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    p, q = (-np.log1p(-z * rate) / np.log(BASE) for z in (x, y))
    dp, dq = (rate / ((1 - z * rate) * np.log(BASE)) for z in (x, y))
    return -larger * v * dp / p - smaller * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs of register rows with known set sizes."""
    counts, u = _agreement(a, b), n_a / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(30):
        middle = (low + high) / 2
        rising = _slope(middle, counts, u) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def may_link(like: Likeness, counts: tuple, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether set sizes allow a link and the likelihood still rises where the slack begins."""
    u = n_a / (n_a + n_b)
    fits = 100 * np.minimum(n_a, n_b) >= like.percent * np.maximum(n_a, n_b)
    return fits & (_slope(like.percent / 100 - like.slack, counts, u) >= 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, registers) of rows (doc_id, text)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            "registers": pa.array([r.tobytes() for r in registers(sets)], pa.binary())})

    return text_step(documents, "text", work, f"doc_id {dict(documents.dtypes)['doc_id']}, n_shingles long, set_key binary, registers binary")


def _bands(classes: DataFrame, like: Likeness) -> DataFrame:
    """(key, c) for every band of every class."""
    bands, width = like.bands, like.rows

    def keys(batches):
        for batch in batches:
            rows = _matrix(batch.column("registers"))[:, :bands * width].reshape(batch.num_rows, bands, width).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (batch.num_rows, bands))
                for k in range(width):
                    key = mixed(key * np.uint64(257) + rows[:, :, k])
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(key.ravel().view(np.int64)),
                "c": pa.array(np.repeat(batch.column("c").to_numpy(), bands))})

    return classes.select("c", "registers").mapInArrow(keys, "key long, c long")


def _dealt(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (key, c, size) with registers, sorted into groups (key, i, j).

    A bucket of up to BLOCK members is one group. A larger one is dealt into
    blocks; a group is then two blocks that meet, so that no group has more
    than about two blocks of rows, however large the bucket is.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("c", "key"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = _meeting(met).drop("size", "blocks").join(classes.select("c", F.col("n_shingles").alias("n"), "registers"), "c")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _meeting(met: DataFrame) -> DataFrame:
    """Rows with the numbers i <= j of the two blocks that meet, in place of ``other``."""
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def _groups(batches):
    """Arrow tables of whole groups from sorted batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        marks = [table.column(k).to_numpy() for k in ("key", "i", "j")]
        last = np.logical_and.reduce([m == m[-1] for m in marks])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _pairs_within(table: pa.Table, step: int = 1 << 15):
    """Index pairs of rows that meet in a group: all of one block, or of two different blocks."""
    key, i, j, own = (table.column(k).to_numpy() for k in ("key", "i", "j", "own"))
    n = len(key)
    change = np.ones(n, bool)
    change[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.cumsum(change)
    left, right, held = [], [], 0
    at, lag = np.arange(n), 1
    while len(at):
        at = at[at + lag < n]
        at = at[group[at] == group[at + lag]]
        met = at[(i[at] == j[at]) | (own[at] != own[at + lag])]
        for a in range(0, len(met), step):
            left.append(met[a:a + step])
            right.append(met[a:a + step] + lag)
            held += len(left[-1])
            if held >= step:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
        lag += 1
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n rows that each row reaches by the links (a, b)."""
    label = np.arange(n)
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
    return label[label]


def _candidates(dealt: DataFrame, like: Likeness) -> DataFrame:
    """(own, other, equal): per class and group the partner with most equal registers, if it may be a link.

    Rows with ``equal`` -1 join what these partners leave apart although some
    pair of the group may be a link, so that the rows of a group, at most two a
    member, connect all that may be linked in it. No other pair is given out.
    """
    def best(batches):
        for table in _groups(batches):
            c, n = table.column("c").to_numpy(), table.column("n").to_numpy().astype(float)
            rows = _matrix(table.column("registers"))
            found = []
            for a, b in _pairs_within(table):
                counts = _agreement(rows[a], rows[b])
                likely = may_link(like, counts, n[a], n[b])
                found.append((a[likely], b[likely], counts[2][likely]))
            x, y, equal = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            if not len(x):
                continue
            a, b, equal = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([equal, equal])
            # A row of the table is one class in one group.
            order = np.lexsort((c[b], -equal, a))
            order = order[np.concatenate([[True], a[order[1:]] != a[order[:-1]]])]
            near, reach = _labels(len(c), a[order], b[order]), _labels(len(c), x, y)
            apart = np.flatnonzero((near == np.arange(len(c))) & (reach != near))
            yield pa.RecordBatch.from_pydict({
                "own": pa.array(np.concatenate([c[a[order]], c[apart]])), "other": pa.array(np.concatenate([c[b[order]], c[reach[apart]]])),
                "equal": pa.array(np.concatenate([equal[order], np.full(len(apart), -1)]), pa.int64())})

    return dealt.select("key", "i", "j", "own", "c", "n", "registers").mapInArrow(best, "own long, other long, equal long")


def _families(candidates: DataFrame, roots: DataFrame, steps: Steps) -> DataFrame | None:
    """(root, family): components that candidates connect beyond their links; None if there are none."""
    def of(c: str, name: str) -> DataFrame:
        return roots.select(F.col("node").alias(c), F.col("root").alias(name))

    ends = candidates.select("own", "other").join(of("own", "u"), "own", "left").join(of("other", "v"), "other", "left")
    open_ = steps.write("open", ends.select(F.coalesce("u", "own").alias("u"), F.coalesce("v", "other").alias("v")).where("u <> v").distinct())
    if open_.isEmpty():
        return None
    return steps.write("families", components(open_, steps).select(F.col("node").alias("root"), F.col("root").alias("family")))


def _family_groups(classes: DataFrame, roots: DataFrame, families: DataFrame, sets_of, steps: Steps) -> DataFrame:
    """(key, i, j, own, c, root, n, registers, set) of the members of families, sorted into groups of two blocks that meet.

    The component with most members of a family is dealt into blocks of its
    own, which need not meet each other. Blocks are bounded by members and by bytes.
    """
    rooted = classes.select("c", F.col("n_shingles").alias("n"), "registers").join(
        roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    members = steps.write("kin", rooted.join(families, "root"))
    blocks = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    sized = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("n") * 8 + REGISTERS).alias("bytes"))
    largest = F.max_by(F.struct("root", blocks.alias("blocks")), F.struct("count", "root"))
    family = sized.groupBy("family").agg(largest.alias("most"), F.sum("count").alias("count"), F.sum("bytes").alias("bytes"), F.max("count").alias("held"),
                                         F.max_by("bytes", F.struct("count", "root")).alias("held_bytes"))
    family = family.select("family", "most.root", "most.blocks", (F.col("count") - F.col("held")).alias("count"), (F.col("bytes") - F.col("held_bytes")).alias("bytes"))
    family = family.select("family", F.col("root").alias("main"), F.col("blocks").alias("p"), blocks.alias("q"))
    placed = members.join(family, "family").withColumn("major", F.col("root") == F.col("main"))
    own = F.when(F.col("major"), F.pmod(F.xxhash64("c"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("c"), F.col("q"))).cast("int")
    met = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(F.col("major"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)))
    full = _meeting(met).withColumnRenamed("family", "key").join(sets_of(members.select("c")), "c")
    return full.select("key", "i", "j", "own", "c", "root", "n", "registers", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _links_across(groups: DataFrame, like: Likeness) -> DataFrame:
    """(u, v): links between components, verified on whole sets where the blocks meet.

    Every pair of different components whose registers allow a link is
    compared unless links found before it in the task connect it. So a group
    gives fewer rows than it has members, whatever the number of pairs.
    """
    def run(batches):
        for table in _groups(batches):
            key, i, j, own, c, root = (table.column(k).to_numpy() for k in ("key", "i", "j", "own", "c", "root"))
            n = table.column("n").to_numpy().astype(float)
            rows = _matrix(table.column("registers"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table.column("set").chunks for x in chunk]
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                label = np.unique(root[a:b], return_inverse=True)[1]
                at = np.arange(a, b)
                left, right = at[own[at] == i[a]], at[own[at] == j[a]]
                for x in left.tolist():
                    others = right[right > x] if i[a] == j[a] else right
                    others = others[label[others - a] != label[x - a]]
                    if not len(others):
                        continue
                    counts = _agreement(rows[x][None], rows[others])
                    others = others[may_link(like, counts, np.full(len(others), n[x]), n[others])]
                    while len(others):
                        some, others = others[:64], others[64:]
                        linked = some[_similar(sets[x], [sets[y] for y in some.tolist()], like)]
                        for y in linked.tolist():
                            if label[y - a] != label[x - a]:
                                found.append((c[x], c[y]))
                                label[label == label[y - a]] = label[x - a]
                        others = others[label[others - a] != label[x - a]]
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return groups.mapInArrow(run, "u long, v long")


def _similar(one: np.ndarray, others: list[np.ndarray], like: Likeness) -> np.ndarray:
    """Which of other sets are linked with a set."""
    size = np.array([len(s) for s in others])
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat((one[place] == flat).astype(np.int64), np.cumsum(size) - size)
    return 100 * both >= like.percent * (len(one) + size - both)


def _bit(keys: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "little") % _FILTER_BITS for k in keys], np.int64)


def _ends(pairs: DataFrame) -> DataFrame:
    """(c): the classes that stand in pairs (x, y), each once per batch of pairs."""
    def run(batches):
        for batch in batches:
            ends = np.union1d(batch.column("x").to_numpy(), batch.column("y").to_numpy())
            yield pa.RecordBatch.from_pydict({"c": pa.array(ends, pa.int64())})

    return pairs.select("x", "y").mapInArrow(run, "c long")


def _needed_sets(documents: DataFrame, wanted: DataFrame, classes: DataFrame, steps: Steps, name: str) -> DataFrame:
    """(c, set): whole shingle sets of the classes ``wanted``, from the documents with the smallest ids.

    A table of fixed size, sent to every task, keeps most other documents from
    being shuffled; the join behind it is exact.
    """
    needed = steps.write(f"{name}-needed", classes.join(wanted.distinct(), "c", "left_semi").select(F.col("least").alias("doc_id"), "set_key", "c"))

    def used(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bit": pa.array(np.unique(_bit(batch.column(0).to_pylist())) + 1, pa.int64())})

    bits = np.zeros(_FILTER_BITS, bool)
    packed = needed.select("set_key").mapInArrow(used, "bit long").select(
        F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place")).groupBy("bucket").agg(
            F.bitmap_construct_agg("place").alias("bits")).collect()
    for bucket, held in packed:
        ones = np.unpackbits(np.frombuffer(bytes(held), np.uint8), bitorder="little")
        bits[(bucket - 1) * len(ones) + np.flatnonzero(ones)] = True
    zero = needed.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"))
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        hit = np.flatnonzero(np.unpackbits(zero.value)[_bit(keys)])
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(hit)), "set_key": pa.array([keys[k] for k in hit], pa.binary()),
            "set": pa.array([sets[k].tobytes() for k in hit], pa.binary())})

    found = text_step(documents, "text", work, f"doc_id {dict(documents.dtypes)['doc_id']}, set_key binary, set binary")
    joined = match(found, needed, ["doc_id", "set_key"])
    return steps.write(name, joined.groupBy("c").agg(F.first("set").alias("set")))


def _verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links (u, v): the pairs whose whole sets are similar enough."""
    joined = pairs.select("x", "y").join(sets.toDF("x", "set_x"), "x").join(sets.toDF("y", "set_y"), "y")

    def check(batches):
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("set_x"), batch.column("set_y")):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                place = np.searchsorted(b, a)
                both = int((b[np.minimum(place, len(b) - 1)] == a).sum())
                linked.append(100 * both >= like.percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_pydict({"u": batch.column("x"), "v": batch.column("y")}).filter(pa.array(linked, pa.bool_()))

    return joined.select("x", "y", "set_x", "set_y").mapInArrow(check, "u long, v long")


def near_duplicates(documents: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two documents are linked if their sets of distinct five-word shingles
    (A-Z as a-z; a shorter text is one shingle) have a Jaccard similarity of at
    least ``percent`` hundredths. Documents with the same set form a class, and only classes are
    compared. Classes that agree in a band of registers and whose joint
    estimate allows a link are candidates. First every class verifies its most
    promising partners on whole sets, which gives as many pairs as bands and
    puts most of a large group into one component. Components that candidates
    still connect form a family. In it members of different components are
    compared block by block, on registers and then on whole sets, where the
    blocks meet: a task gives out the links that join components, fewer than it
    has members, and no candidate pair is ever a row. Within a family whose
    members are near misses of each other the comparisons stay quadratic, but
    blocks spread them over tasks.

    ``component_id`` is the smallest id that a document reaches, itself
    included, and ``kept`` tells that it is the document's own. A text without
    words (null, empty, white space) is linked with nothing. Rows that share an
    id count as one document: equal ids are kept or not together, and an id
    whose rows lie in several components reports each row's own. A null id is
    never the smallest unless its component has no other. Shingles are 64-bit
    hashes. No rows give no rows; other columns of the input are ignored.
    """
    steps, like = Steps(documents.sparkSession, "near"), Likeness(percent)
    source = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    sketched = steps.write("sketches", sketches(source))
    classes = steps.write("classes", sketched.where("n_shingles > 0").groupBy("set_key", "n_shingles", "registers")
                          .agg(F.min("doc_id").alias("least")).withColumn("c", F.monotonically_increasing_id()))
    bands = _bands(classes, like)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = steps.write("members", bands.join(shared, "key"))
    candidates = steps.write("candidates", _candidates(_dealt(members, classes), like).distinct())
    nearest = Window.partitionBy("own").orderBy(F.col("equal").desc(), "other")
    first = steps.write("first", candidates.where("equal >= 0").withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= FIRST_PARTNERS)
                        .select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).distinct())
    links = steps.write("links", _verified(first, _needed_sets(source, _ends(first), classes, steps, "first-sets"), like))
    roots = steps.write("roots", components(links, steps))
    families = _families(candidates, roots, steps)
    if families is not None:
        more = steps.write("more", _links_across(_family_groups(
            classes, roots, families, lambda wanted: _needed_sets(source, wanted, classes, steps, "kin-sets"), steps), like))
        if not more.isEmpty():
            # From the stars found so far, so that few rounds are left.
            stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = steps.write("all", components(stars.union(more), steps))
    grouped = classes.join(roots, F.col("c") == F.col("node"), "left").select("set_key", F.coalesce("root", "c").alias("root"), "least")
    heads = grouped.groupBy("root").agg(F.min("least").alias("component"))
    found = steps.write("found", grouped.join(heads, "root").select("set_key", "component"))
    steps.drop(*[s for s in list(steps.paths) if s not in ("sketches", "found")])
    rows = sketched.drop("registers").join(found, "set_key", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
                       ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that head their components, with all their columns.

    Rows are told apart by id and text, so different texts without id or with
    one id are documents of their own; of rows with one id the hash of the text
    decides which is smaller. Of rows with the same id and text one stays.
    """
    found = near_duplicates(keyed(documents, id_col, text_col), **options).groupBy("doc_id").agg(
        F.bool_or("kept").alias("keep"), (F.count(F.lit(1)) > 1).alias("single"))
    return rows_by_key(documents, id_col, text_col, found.where("not keep or single"))
