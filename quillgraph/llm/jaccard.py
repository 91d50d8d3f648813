"""N-gram Jaccard join by grouped prefixes, giving the components of the link graph.

A document is its set of word n-grams. Sets are ordered by how often their n-grams occur (a count sketch over
all documents; any order is right, this one is quick), rarest first. Two sets that are similar enough share an
n-gram in their prefixes. Documents with equal sets become one node; sets of one size with the same prefix
become one group, and only groups stand in the prefix lists. Candidates come in three rounds, so that a group of
near copies costs links in proportion to its size, not to its square:

1. neighbours in prefix lists, ordered by size, and each group's members with its first;
2. after components of these, of each group in each list the nearest one by parity maps that lies in another
   component, if bounds on size, place and maps leave it;
3. after components again, all such pairs. Groups expand to their members unless they lie wholly in one component.

Every candidate is verified on the whole texts, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHash, arrow_pass, checkpoint, grams, read, stored, tasks_for
from .graph import components

#: Counters of the sketch (a power of two) and the pieces in which it travels.
SKETCH, SLICES = 1 << 20, 64

#: Bits of a set's parity map: two sets differ in at least as many n-grams as their maps in bits.
BITS = 512

#: Rows of a list that are compared in one cell; longer lists are cut into 8 blocks, of LIST / 2 to 8 * LIST rows each.
LIST = 1_024

#: Candidates of each group in the first round.
FIRST = 2

#: Sketches of so many tasks are added up in one group; above it, in levels.
FAN_IN = 64

#: Copies of a lookup row, so that the rows of one hot key spread over so many tasks.
SALTS = 16

#: Pairs of one document that are verified in one task; the text of one in more pairs is copied to several.
PAIRS = 256

#: Up to so many ids are broadcast to pick the texts to verify; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(text: str | None, words: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words; of fewer words, the whole sequence as one; none without words."""
    if not text or not (own := text.encode("utf-8", "surrogatepass").lower().split()):
        return np.array([], np.uint64)
    n = min(words, len(own))
    return np.unique(grams(hashes.of(own), n, seed=n))


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How often n-grams fall on each of SKETCH counters, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, total = WordHash(), np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, words, hashes) for t in batch[0].slice(at, 256).to_pylist()]
                places = (np.concatenate(sets) >> np.uint64(20) & np.uint64(SKETCH - 1)).astype(np.int64)
                total += np.bincount(places, minlength=SKETCH).astype(np.uint32)
        yield part(total, TaskContext.get().partitionId())

    def part(total: np.ndarray, task: int) -> pa.RecordBatch:
        pieces = [x.tobytes() for x in np.split(total, SLICES)]
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array(pieces, pa.binary())], ["slice", "task", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, task, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = np.frombuffer(counts, np.uint32)
                sums[key, task] = sums[key, task] + new if (key, task) in sums else new
        if sums:
            keys, tasks = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(tasks, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "task", "counts"])

    schema = "slice int, task int, counts binary"
    texts = docs.select("text")
    parts, tasks = texts.mapInArrow(run, schema), tasks_for(texts)  # of more tasks, more sums reach the driver
    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).repartition("slice", "task").mapInArrow(add, schema)
        if tasks <= 1:
            break
    total = np.zeros(SKETCH, np.uint32)
    for r in parts.collect():  # SLICES rows, SKETCH counters together
        total.reshape(SLICES, -1)[r["slice"]] += np.frombuffer(r["counts"], np.uint32)
    return total


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """For each document: set size, key of the set, key of the group (prefix and size), prefix, rarest n-gram first, and parity map."""
    told = docs.sparkSession.sparkContext.broadcast(counts)

    def make():
        hashes, often = WordHash(), told.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, keys, groups, lists, maps = [], [], [], [], []
            for text in batch[1].to_pylist():
                own = shingle_set(text, words, hashes)
                n = len(own)
                sizes.append(n)
                if not n:
                    keys.append(None), groups.append(None), lists.append(None), maps.append(None)
                    continue
                odd = np.bincount((own >> np.uint64(44) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                maps.append(np.packbits(odd.astype(bool)).tobytes())
                order = np.lexsort((own, often[(own >> np.uint64(20) & np.uint64(SKETCH - 1)).astype(np.int64)]))
                first = own[order[: n - -(-percent * n // 100) + 1]]
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                groups.append(xxhash.xxh3_128_digest(first.tobytes() + n.to_bytes(8, "little")))
                lists.append(first.view(np.int64))
            return pa.RecordBatch.from_arrays(
                [batch[0], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(groups, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                ["doc_id", "n", "set_key", "group_key", "prefix", "bits"],
            )

        return work

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n long, set_key binary, group_key binary, prefix array<long>, bits binary")


def listed(groups: DataFrame) -> DataFrame:
    """The prefix lists: (token, n, gid, place), ordered by token, then size. A hot token's list goes over several partitions."""
    rows = groups.select("gid", "n", F.posexplode("prefix").alias("place", "token"))
    order = ["token", "n", "gid"]
    return rows.select("token", "n", "gid", "place").repartitionByRange(*order).sortWithinPartitions(*order)


def _near(n1, p1, n2, p2, percent: int):
    """Whether two sets, the first not the larger, may be similar enough if their first shared n-gram is at these places."""
    return (100 * n1 >= percent * n2) & (np.minimum(n1 - p1, n2 - p2) >= -(-percent * (n1 + n2) // (100 + percent)))


def neighbours(lists: DataFrame, percent: int) -> DataFrame:
    """The lists without groups that no other can match there, and with each row (as `before`) the row in front if these two can.

    Lists of up to three rows are judged pair by pair; of longer ones all rows stay, as do those of a partition's first and
    last list, which may go on in the next partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((4, 0), np.int64)  # the last list so far, or of a long one its last row
        long = False  # whether rows of that list have been given out
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.column_stack([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])])
            first = int(cols[0, 0]) if first is None else first
            last = int(np.flatnonzero(cols[0] != cols[0, -1])[-1]) + 1 if cols[0, 0] != cols[0, -1] else 0
            if last:
                yield from judged(cols[:, :last], long, first)
                long = False
            rest = cols[:, last:]
            if rest.shape[1] > 4096:
                yield from judged(rest, long, int(rest[0, 0]))
                rest, long = rest[:, -1:], True
        if rest.shape[1]:
            yield from judged(rest, long, int(rest[0, 0]))

    def judged(cols: np.ndarray, long: bool, whole: int) -> Iterator[pa.RecordBatch]:
        """`whole`: the list of which all rows stay. `long`: rows before the first one's are given out, as is this one itself."""
        token, n, gid, place = cols
        size = len(token)

        def pair(k: int) -> np.ndarray:
            ok = np.zeros(size, bool)
            if size > k:
                ok[k:] = (token[k:] == token[:-k]) & _near(n[:-k], place[:-k], n[k:], place[k:], percent)
            return ok

        one, two = pair(1), pair(2)
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.repeat(np.diff(np.concatenate([start, [size]])), np.diff(np.concatenate([start, [size]])))
        keep = (length > 3) | one | two
        keep[:-1] |= one[1:]
        keep[:-2] |= two[2:]
        keep |= token == whole
        if long:
            keep |= token == token[0]
            keep[0] = False
        if keep.any():
            before = np.concatenate([gid[:1], gid[:-1]])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[keep]) for x in (token, n, gid)), pa.array(place[keep].astype(np.int32)), pa.array(before[keep], mask=~one[keep])],
                ["token", "n", "gid", "place", "before"],
            )

    return lists.mapInArrow(run, "token long, n long, gid long, place int, before long")


def long_lists(lists: DataFrame) -> DataFrame:
    """token, rows: the lists of more than LIST rows."""
    return lists.groupBy("token").agg(F.count("*").alias("rows")).where(f"rows > {LIST}")


def blocked(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Adds cell, across, own and main. Long lists are compared in cells, each with some rows of two blocks of the list.

    The rows of a list's largest component (main) make no pairs with each other, so they meet only the others: main block a
    and other block b in cell a * across + b. Blocks i <= j of the others meet in cell -1 - (i * across + j). `across` is the
    number of blocks of others (0: the list is whole in cell 0), `own` the number of the row's block.
    """
    if long.isEmpty():
        return rows.withColumns({"cell": F.lit(0).cast("long"), "across": F.lit(0), "own": F.lit(0), "main": F.lit(False)})
    few = long.count() <= BROADCAST_IDS
    sized = F.broadcast(long) if few else long
    held = rows.where("low = high").join(sized, "token").groupBy("token", "low").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("low", "k").alias("top"), F.max("k").alias("k"))
    told = long.join(held, "token", "left")  # a row for each long list
    tagged = rows.join(F.broadcast(told) if few else told, "token", "left")
    main = F.coalesce((F.col("low") == F.col("high")) & (F.col("low") == F.col("top")), F.lit(False))
    top = F.coalesce("k", F.lit(0))
    block = F.greatest(F.lit(LIST // 2), F.least(F.lit(8 * LIST), F.ceil(F.col("rows") / 8)))
    tagged = tagged.withColumns({"main": main, "down": F.ceil(top / block).cast("long"), "across": F.coalesce(F.ceil((F.col("rows") - top) / block).cast("long"), F.lit(0).cast("long"))})
    # a long list that is one component makes no pairs
    tagged = tagged.where("rows IS NULL OR across > 0")
    hashed = F.pmod(F.xxhash64("gid"), F.greatest(F.when(F.col("main"), F.col("down")).otherwise(F.col("across")), F.lit(1).cast("long")))
    tagged = tagged.withColumn("own", hashed)

    def upto(n: str):
        return F.filter(F.sequence(F.lit(0).cast("long"), F.col(n)), lambda i: i < F.col(n))

    with_others = F.transform(upto("across"), lambda j: -1 - (F.least("own", j) * F.col("across") + F.greatest("own", j)))
    with_main = F.transform(upto("down"), lambda a: a * F.col("across") + F.col("own"))
    of_main = F.transform(upto("across"), lambda b: F.col("own") * F.col("across") + b)
    cells = F.when(F.col("rows").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("main"), of_main).otherwise(F.concat(with_others, with_main))
    tagged = tagged.withColumn("cell", F.explode(cells))
    return tagged.select("token", "n", "gid", "place", "low", "high", "bits", "cell", F.col("across").cast("int"), F.col("own").cast("int"), "main")


def open_pairs(lists: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs of groups of one list that may hold a link not yet in a component. Rows: token, n, gid, place, low, high, bits,
    cell, across, own, main (see blocked), those of one cell of a list together and ordered by n.

    low and high are the least and the largest component of a group's members; bits is the parity map of a group with one
    set, else null. The bounds on size and place are those of the first shared n-gram; a pair with a link passes them there.
    Its maps differ in no more bits than its sets may differ in n-grams. nearest: of each row's pairs in a list, only one
    with the fewest such bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the last list so far: it may go on, so it is worked on in parts
        tail = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            token, cell = batch[0].to_numpy(), batch[7].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(token) != 0) | (np.diff(cell) != 0)) + 1])
            low, high = batch[4].to_numpy(), batch[5].to_numpy()
            mixed = np.minimum.reduceat(low, cuts) != np.maximum.reduceat(high, cuts)
            ends = np.concatenate([cuts[1:], [len(token)]])
            out = []
            for start, end in zip(cuts[:-1][mixed[:-1]].tolist(), ends[:-1][mixed[:-1]].tolist(), strict=True):
                pairs_of(columns(batch.slice(start, end - start)), tail if start == 0 else 0, out)
            start = int(cuts[-1])
            if start:
                tail = None
            # of a list that goes on, rows too small for any later one are done with
            last = batch.slice(start)
            pairs_of(columns(last), tail or 0, out) if len(last) > 4096 else None
            if len(last) > 4096:
                n = last[1].to_numpy()
                first = int(np.searchsorted(n, -(-percent * n[-1] // 100)))
                last = last.slice(first)
                tail = len(last)
            rest = last
            if out:
                yield given(out)
        out = []
        if rest is not None:
            pairs_of(columns(rest), tail or 0, out)
        if out:
            yield given(out)

    def columns(part: pa.RecordBatch) -> tuple:
        maps = part[6].to_pylist()
        known = np.array([m is not None for m in maps])
        bits = np.frombuffer(b"".join(m or bytes(BITS // 8) for m in maps), np.uint64).reshape(len(maps), -1)
        return (*(part[i].to_numpy().astype(np.int64) for i in range(1, 6)), bits, known, part[7][0].as_py(), part[8][0].as_py(), part[9].to_numpy(), part[10].to_numpy(zero_copy_only=False))

    def pairs_of(cols: tuple, done: int | None, out: list) -> None:
        """Pairs of which the later row stands at `done` or after. Rows wholly in the list's largest component make none with
        each other, so only the others are gone through; these meet all rows before, and the largest component's after."""
        n, gid, place, low, high, bits, known, cell, across, own, main = cols
        if not across:
            parts, sizes = np.unique(low[low == high], return_counts=True)
            main = (low == high) & (low == parts[np.argmax(sizes)]) if len(parts) else np.zeros(len(n), bool)
        for i in np.flatnonzero(~main).tolist():
            first = int(np.searchsorted(n, -(-percent * n[i] // 100)))
            last = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
            at = np.arange(first, last)
            at = at[((at < i) | main[at] & (at > i)) & (np.maximum(at, i) >= (done or 0)) & (gid[at] != gid[i])]
            if across and cell >= 0:
                at = at[main[at]]
            elif across:  # of one block two rows are together in many cells; they meet in the one of that block alone
                at = at[np.minimum(own[at], own[i]) * across + np.maximum(own[at], own[i]) == -1 - cell]
            need = -(-percent * (n[at] + n[i]) // (100 + percent))
            fits = np.minimum(n[at] - place[at], n[i] - place[i]) >= need
            fits &= ~((low[at] == high[at]) & (low[at] == low[i]) & (low[i] == high[i]))
            at, need = at[fits], need[fits]
            if not len(at):
                continue
            apart = np.where(known[at] & known[i], np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64), 0)
            ok = n[at] + n[i] - apart >= 2 * need
            at = at[ok]
            if nearest and len(at):
                at = at[[np.argmin(apart[ok])]]
            if len(at):
                out.append((gid[at], gid[i]))

    def given(out: list) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in out])
        b = np.concatenate([np.full(len(x), y) for x, y in out])
        pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose texts are similar enough. One checkpointed table.

    A document in many pairs, as the first of a large group is, is no hot key: its pairs are dealt out by salts.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct().persist(StorageLevel.DISK_ONLY)
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = texts.join(some, "doc_id", "left_semi")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts")).where("salts > 1").persist(StorageLevel.DISK_ONLY)
    hot = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    one = F.coalesce("salts", F.lit(1))
    salted = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), one).cast("int").alias("salt"))
    first = chosen.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(hot, "a", "left")
    first = first.select("a", "text_a", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"))

    def make():
        hashes, kept = WordHash(), {}

        def of(doc: int, text: str) -> np.ndarray:
            if kept.get("doc") != (doc, len(text)) or kept["text"] != text:
                kept.update(doc=(doc, len(text)), text=text, set=shingle_set(text, words, hashes))
            return kept["set"]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for a, b, t, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = of(a, t), shingle_set(u, words, hashes)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            return pa.RecordBatch.from_arrays([batch[0], batch[1]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return work

    with_b = salted.join(chosen.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(first, ["a", "salt"]).select("a", "b", "text_a", "text_b")
    found = checkpoint(arrow_pass(both, make, "a long, b long").distinct())
    ids.unpersist()
    many.unpersist()
    return found


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id that links reach, the row's own included.

    Two documents link when 100 * shared n-grams >= percent * n-grams in either. Words are runs without ASCII blanks, A-Z
    in lower case. Null texts and texts without words have size 0 and link with nothing. Rows with the same doc_id are one
    document; a null doc_id links with nothing and has a null component. An empty table gives no rows.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    base = stored(prefixes(docs, sketch(docs, words), words, percent), "prefixes")
    own = base.where("n > 0 AND doc_id IS NOT NULL")
    sets = checkpoint(own.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("group_key").alias("group_key"), F.min("n").alias("n"), F.count("*").alias("copies")))
    # one row per group; its rows all have the same prefix
    groups = own.groupBy("group_key").agg(F.min("doc_id").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    maps = own.groupBy("group_key").agg(F.min("doc_id").alias("gid"), F.min("bits").alias("bits"), F.max("bits").alias("other")).where("bits = other").select("gid", "bits")
    lists = stored(neighbours(listed(groups), percent), "lists")

    many = sets.groupBy("group_key").agg(F.min("rep").alias("gid"), F.count("*").alias("members")).where("members > 1").select("group_key", "gid")
    members = checkpoint(sets.join(many, "group_key").select("gid", "rep"))
    chain = lists.where("before IS NOT NULL").select(F.col("n"), F.least("before", "gid").alias("a"), F.greatest("before", "gid").alias("b"))
    chain = chain.groupBy("a", "b").agg(F.count("*").alias("lists"), F.min("n").alias("n"))
    # neighbours in few of their lists share little; they are left to the later rounds
    often = F.col("lists") >= 0.2 * (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    most = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("lists"), "a"))
    chain = chain.where(often).withColumn("k", most).where(f"k <= {FIRST}").select("a", "b")
    star = members.where("gid != rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    tried = checkpoint(chain.unionAll(star).where("a != b").distinct())
    # rows that share a doc_id are one document, whatever their sets
    twice = own.select("doc_id", "set_key").distinct().groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    joined = own.join(F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice, "doc_id").select("doc_id", "set_key").distinct()
    joined = joined.join(sets.select("set_key", "rep"), "set_key").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = verified(tried, texts, words, percent).unionAll(checkpoint(joined))
    label = components(links)
    long = checkpoint(long_lists(lists))
    for nearest in (True, False):
        pairs = _open(lists, long, maps, members, label, percent, nearest).join(tried, ["a", "b"], "left_anti")
        pairs = checkpoint(pairs)
        if pairs.isEmpty():
            continue
        more = verified(pairs, texts, words, percent)
        tried = tried.unionAll(pairs)
        if not more.isEmpty():
            links = links.unionAll(more)
            label = components(links)

    whole = sets.join(label, sets["rep"] == label["node"], "left").select("set_key", "copies", "rep", F.coalesce("label", "rep").alias("component"))
    moved = whole.where("copies > 1 OR component != rep").select("set_key", "component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = base.select("doc_id", "n", "set_key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = out.join(moved, ["set_key", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _open(lists: DataFrame, long: DataFrame, maps: DataFrame, members: DataFrame, label: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of sets in different components that a list, or a group, has together and the bounds leave."""
    parts = members.join(label, members["rep"] == label["node"], "left").select("gid", "rep", F.coalesce("label", "rep").alias("part"))
    parts = checkpoint(parts)
    wide = parts.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    parted = maps.join(wide, "gid", "full").join(label.withColumnRenamed("node", "gid"), "gid", "left")
    parted = parted.select("gid", F.coalesce("low", "label", "gid").alias("low"), F.coalesce("high", "label", "gid").alias("high"), F.when(F.col("low").isNull(), F.col("bits")).alias("bits"))
    rows = blocked(lists.select("token", "n", "gid", "place").join(parted, "gid").select("token", "n", "gid", "place", "low", "high", "bits"), long)
    pairs = open_pairs(rows.repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "gid"), percent, nearest).distinct()
    pairs = pairs.unionAll(wide.where("low != high").select(F.col("gid").alias("a"), F.col("gid").alias("b")))

    def side(x: str) -> DataFrame:
        return parts.select(F.col("gid").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("part").alias(f"part_{x}"))

    opened = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    opened = opened.select(F.coalesce("rep_a", "a").alias("a"), F.coalesce("rep_b", "b").alias("b"), "part_a", "part_b").where("part_a IS NULL OR part_b IS NULL OR part_a != part_b")
    return opened.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id is the smallest of its component.

    Rows with a null doc_id and rows without words stay, as they link with nothing; rows that repeat a doc_id stay or go
    together; an empty table gives no rows; whole texts count, however long, and other columns are left as they are.
    """
    gone = similar(docs, words, percent).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents"), words=4, percent=85)
