"""Jaccard join of documents on word shingles, and its components.

Equal shingle sets collapse into one node first. Each node's shingles are
ordered rare first: shingles of many nodes are counted exactly and come last, by
count. Two sets that are similar enough share a shingle in their prefixes of that
order, so nodes meet on prefix shingles. Where two nodes first meet, the shingles
before that place belong to one of them only, which bounds how far apart they are
(positional filter). A node is first compared with the leader of each list it is
in, the node whose prefix reaches the shingle soonest; lists whose nodes are then
one component need no more work, which spares large groups of near copies their
pairs. What is left are pairs across components, thinned by length, position and
by how many of the leader's shingles each side lacks. Each pair is verified once
on whole texts, with a suffix filter before the exact count.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import discard, release, stash
from barloom.llm.components import components, merged

WORDS = 5
PERCENT = 80
#: Shingles of more nodes than this are frequent and ordered by their count.
FREQUENT = 24
#: Frequent shingles or wanted ids up to this many bytes go to all tasks; more are joined by shuffle instead.
BROADCAST_BYTES = 64 << 20
#: Bytes of text for each part in which shingles are counted.
BYTES_PER_PART = 6 << 20
#: Hot components are dealt to this many places when their smallest id is handed out.
SALTS = 16
#: Rows of text a task holds at once, and those whose shingles it counts at once.
ROWS = 512
COUNTED = 2048

_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; those of fewer words are one, without words there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * _K + own[k : len(own) - width + 1 + k]
    return np.unique(_mixed(out))


def node_of(shingles: np.ndarray) -> int:
    """The 64-bit name of a set, the same for equal sets."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _pieces(texts: pd.Series) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(texts), ROWS):
        yield [shingle_set(t) for t in texts.iloc[i : i + ROWS]]


def frequent_shingles(docs: DataFrame, n_bytes: int) -> tuple[DataFrame, int]:
    """Exact node counts of the frequent shingles, in sorted blocks: part, keys and counts (binary, int64 and int32).

    A key is a shingle hash cut to 32 bits more than name its part, so chance
    meetings stay as rare at every size. Tasks count what they have before
    anything is shuffled, and send sorted arrays instead of rows. Copies of a
    document count once in a task's batch.
    """
    bits = max(6, (max(1, n_bytes) // BYTES_PER_PART).bit_length())
    shift = np.uint64(64 - bits - 32)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), COUNTED):
                seen: dict[int, np.ndarray] = {}
                for found in _pieces(batch["text"].iloc[low : low + COUNTED]):
                    seen.update((node_of(s), s) for s in found if len(s))
                if not seen:
                    continue
                keys, counts = np.unique(np.concatenate(list(seen.values())) >> shift, return_counts=True)
                edge = np.searchsorted(keys >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
                low_bits, counts = keys.astype(np.uint32), np.minimum(counts, (1 << 31) - 1).astype(np.int32)
                rows = []
                for k in range(1 << bits):
                    a, b = edge[k], edge[k + 1]
                    if a < b:
                        many = np.nonzero(counts[a:b] > 1)[0].astype(np.int32)
                        rows.append((k, low_bits[a:b].tobytes(), many.tobytes(), counts[a:b][many].tobytes()))
                yield pd.DataFrame(rows, columns=["part", "keys", "many", "counts"])

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for k, m, c in zip(rows["keys"], rows["many"], rows["counts"], strict=True):
            keys.append(np.frombuffer(k, dtype=np.uint32))
            n = np.ones(len(keys[-1]), dtype=np.int64)
            n[np.frombuffer(m, dtype=np.int32)] = np.frombuffer(c, dtype=np.int32)
            counts.append(n)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        sums = np.add.reduceat(counts, first)
        hot = sums > FREQUENT
        full = (np.int64(key[0]) << 32) | keys[first][hot].astype(np.int64)
        return pd.DataFrame({"part": [key[0]], "keys": [full.tobytes()], "counts": [np.minimum(sums[hot], (1 << 31) - 1).astype(np.int32).tobytes()]})

    blobs = docs.select("text").mapInPandas(emit, "part int, keys binary, many binary, counts binary")
    return blobs.groupBy("part").applyInPandas(add_up, "part int, keys binary, counts binary"), int(shift)


def prefixes(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, text_hash, n (shingles), node (null without shingles) and ``prefix``.

    A prefix holds the first shingles of the node in the rare-first order. It is
    there for one row at least of each node and null for others.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted, shift = frequent_shingles(docs, n_bytes)
    counted = stash(counted)
    release(docs.sparkSession)
    size = counted.agg(F.sum(F.octet_length("keys") + F.octet_length("counts"))).first()[0] or 0
    ranked = _ranked_in_tasks if size <= BROADCAST_BYTES else _ranked_by_join
    return stash(ranked(docs, counted, shift))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def _ranked_in_tasks(docs: DataFrame, counted: DataFrame, shift: int) -> DataFrame:
    """Rank within each task against the frequent shingles, whose size has been checked."""
    rows = counted.orderBy("part").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.int64) for r in rows] or [np.empty(0, dtype=np.int64)]).astype(np.uint64)
    counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.int32) for r in rows] or [np.empty(0, dtype=np.int32)])
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, df = shared.value
        seen = set()
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                out = []
                for s in map(shingle_set, batch["text"].iloc[low : low + ROWS]):
                    node = node_of(s) if len(s) else None
                    if node is None or node in seen:
                        out.append((len(s), node, None))
                        continue
                    seen.add(node)
                    key = s >> np.uint64(shift)
                    at = np.searchsorted(known, key)
                    at[at == len(known)] = 0
                    weight = np.where(known[at] == key, df[at], 0) if len(known) else np.zeros(len(s), dtype=np.int32)
                    # s is sorted, so a stable sort by count breaks ties by hash
                    pick = np.argsort(weight, kind="stable")[: prefix_size(len(s))]
                    out.append((len(s), node, s[pick].astype(np.int64)))
                part = batch[["doc_id", "text_hash"]].iloc[low : low + ROWS].assign(n=[o[0] for o in out], prefix=[o[2] for o in out])
                part["node"] = pd.array([o[1] for o in out], dtype="Int64")
                yield part[["doc_id", "text_hash", "n", "node", "prefix"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _named(docs).mapInPandas(emit, f"doc_id {kind}, text_hash long, n long, node long, prefix array<long>")


def _ranked_by_join(docs: DataFrame, counted: DataFrame, shift: int) -> DataFrame:
    """The same ranking by joining every shingle with the frequent ones, whatever their number."""

    @F.pandas_udf("n long, node long")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(len(s), node_of(s) if len(s) else None) for part in _pieces(texts) for s in part]
            yield pd.DataFrame({"n": [r[0] for r in rows], "node": pd.array([r[1] for r in rows], dtype="Int64")})

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _pieces(batch["text"]):
                for s in part:
                    if len(s):
                        yield pd.DataFrame({"shingle": s.astype(np.int64), "key": (s >> np.uint64(shift)).astype(np.int64), "rank": np.arange(len(s), dtype=np.int32), "node": node_of(s), "n": np.int32(len(s))})

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, c in zip(batch["keys"], batch["counts"], strict=True):
                yield pd.DataFrame({"key": np.frombuffer(k, dtype=np.int64), "df": np.frombuffer(c, dtype=np.int32)})

    measured = stash(_named(docs).select("doc_id", "text_hash", measure("text").alias("m")).select("doc_id", "text_hash", "m.*"))
    rows = docs.select("text").mapInPandas(explode, "shingle long, key long, rank int, node long, n int").dropDuplicates(["node", "shingle"])
    known = counted.mapInPandas(unpack, "key long, df int")
    order = Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(0)), "rank")
    size = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    picked = rows.join(known, "key", "left").withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < size)
    prefix = picked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "shingle"))).alias("p")).select("node", F.col("p.shingle").alias("prefix"))
    return measured.join(prefix, "node", "left").select("doc_id", "text_hash", "n", "node", "prefix")


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, exact: bool = False) -> tuple[int, int]:
    """Sizes of intersection and union; (0, 1) where the suffix filter rules the pair out.

    Cut at a's median, the sets differ at least by the differences of their
    halves' sizes; beyond what the threshold allows no exact count is needed.
    """
    allowed = (100 - percent) * (len(a) + len(b)) // (100 + percent)
    half = np.searchsorted(b, a[len(a) // 2])
    if not exact and abs(len(a) // 2 - half) + abs((len(a) - len(a) // 2) - (len(b) - half)) > allowed:
        return 0, 1
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both, len(a) + len(b) - both


def verify(pairs: DataFrame, texts: DataFrame, exact: bool = False) -> DataFrame:
    """Add ``both`` and ``union``, the exact sizes, to pairs (x, y) of nodes; each pair comes once.

    Pairs that the suffix filter rules out have no sizes, unless they are to be exact.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def own(node: int, text: str) -> np.ndarray:
            if node not in recent:
                recent[node] = shingle_set(text)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[node]

        for batch in batches:
            sizes = [similar(own(x, s), own(y, t), exact=exact) for x, y, s, t in zip(batch["x"], batch["y"], batch["s"], batch["t"], strict=True)]
            yield pd.DataFrame({"x": batch["x"], "y": batch["y"], "both": np.array([v[0] for v in sizes], dtype=np.int64), "union": np.array([v[1] for v in sizes], dtype=np.int64)})

    left = texts.select(F.col("node").alias("x"), F.col("text").alias("s"))
    right = texts.select(F.col("node").alias("y"), F.col("text").alias("t"))
    return pairs.select("x", "y").join(left, "x").join(right, "y").mapInPandas(count, "x long, y long, both long, union long")


def _texts(docs: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """The text of one row of each of the nodes in ``pairs``.

    A row is found by its id, null or not, and the hash of its text, so that rows
    of one id keep their own texts.
    """
    wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    found = known.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(row).alias("row"))
    found = stash(found.select("node", F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash")))
    if 48 * found.count() <= BROADCAST_BYTES:
        found = F.broadcast(found)
    same = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return stash(_named(docs).join(found, same).groupBy("node").agg(F.min("text").alias("text")))


def _near(a: str, b: str) -> Column:
    return 100 * F.least(F.col(a), F.col(b)) >= PERCENT * F.greatest(F.col(a), F.col(b))


def _apart_at_most(least: Column, n: Column) -> Column:
    """Whether sets of ``n`` shingles together, of which ``least`` are in one only, can still be similar."""
    return (100 + PERCENT) * least <= (100 - PERCENT) * n


def _meet(a: str, b: str, pos: str = "pos", other_pos: str = "pos", n: str = "n", other_n: str = "n") -> Column:
    """Length and positional filter of two rows of a list, as if it were the first where the two meet."""
    c = F.col
    ahead = c(f"{a}{pos}") + c(f"{b}{other_pos}")
    rest = F.abs((c(f"{a}{n}") - c(f"{a}{pos}")) - (c(f"{b}{other_n}") - c(f"{b}{other_pos}")))
    return _near(f"{a}{n}", f"{b}{other_n}") & _apart_at_most(ahead + rest, c(f"{a}{n}") + c(f"{b}{other_n}"))


def _linked(sizes: DataFrame) -> DataFrame:
    return sizes.filter(100 * F.col("both") >= PERCENT * F.col("union")).select("x", "y")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def shared_lists(known: DataFrame) -> DataFrame:
    """The lists of two nodes and more: shingle, node, n, pos, how many there are, and the leader with its n and pos."""
    of_nodes = known.filter("prefix is not null").groupBy("node").agg(F.min("n").cast("int").alias("n"), F.min("prefix").alias("prefix"))
    rows = of_nodes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle")).repartition("shingle")
    # both read one exchange
    shared = rows.groupBy("shingle").agg(F.count("*").alias("many")).filter("many > 1")
    lists = stash(rows.join(shared.hint("shuffle_hash"), "shingle"))
    release(known.sparkSession)
    heads = lists.groupBy("shingle").agg(F.min(F.struct("pos", "node", "n")).alias("head"))
    return lists.join(heads, "shingle").select("shingle", "node", "n", "pos", "many", F.col("head.node").alias("leader"), F.col("head.n").alias("leader_n"), F.col("head.pos").alias("leader_pos"))


def linked_groups(docs: DataFrame, known: DataFrame, lists: DataFrame) -> DataFrame:
    """Components of the nodes that any link joins; not all links are formed, but those that are give the same components."""
    spark = docs.sparkSession
    led_by = lists.filter((F.col("node") != F.col("leader")) & _meet("", "leader_", n="n", other_n="n"))
    first = stash(led_by.select(F.col("node").alias("x"), F.col("leader").alias("y")).distinct())
    texts = _texts(docs, known, first)
    led = stash(verify(first, texts, exact=True))
    discard(texts)
    release(spark)
    groups = components(_linked(led))

    # lists of three and more whose nodes are not yet one component; pairs with the leader are settled
    of = lambda side, name: groups.select(F.col("node").alias(side), F.col("component").alias(name))
    grouped = lists.filter("many > 2").join(of("node", "component"), "node", "left").join(of("leader", "lead_component"), "leader", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "node")).withColumn("apart", F.col("component") != F.coalesce("lead_component", "leader"))
    split = grouped.groupBy("shingle").agg(F.max("apart").alias("apart")).filter("apart").select("shingle")
    # what of the leader a node lacks, known where they were compared
    lacks = led.select(F.col("x").alias("node"), F.col("y").alias("leader"), "both")
    open_ = stash(
        grouped.filter("node <> leader")
        .join(split, "shingle", "left_semi")
        .join(lacks, ["node", "leader"], "left")
        .select("shingle", "node", "n", "pos", "component", "apart", (F.col("pos") - F.col("leader_pos")).alias("own"), (F.col("leader_n") - F.col("both")).alias("lacks"))
    )
    discard(lists)
    c = F.col
    # shingles ahead of the meeting place that the leader has not either, and the difference in what they lack of it
    beside_leader = c("a.own") + c("b.own") + F.abs(c("a.lacks") - c("b.lacks"))
    meeting = (
        (c("a.shingle") == c("b.shingle"))
        & (c("a.component") != c("b.component"))
        & (~c("b.apart") | (c("a.node") < c("b.node")))
        & _meet("a.", "b.")
        & F.coalesce(_apart_at_most(beside_leader, c("a.n") + c("b.n")), F.lit(True))
    )
    pairs = open_.filter("apart").alias("a").join(open_.alias("b"), meeting).select(*_ordered(c("a.node"), c("b.node"))).distinct()
    second = stash(pairs.join(led.select(*_ordered(c("x"), c("y"))), ["x", "y"], "left_anti"))
    discard(open_)
    release(spark)
    texts = _texts(docs, known, second)
    found = stash(_linked(verify(second, texts)))
    discard(texts)
    return merged(groups, found)


def _components_of_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row."""
    ranked = prefixes(docs)
    lists = stash(shared_lists(ranked))
    known = stash(ranked.drop("prefix"))
    discard(ranked)
    release(docs.sparkSession)
    groups = linked_groups(docs, known, lists)
    own = stash(known.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("own_id")))
    # a component may have very many nodes: its smallest id is found by partial sums and handed out by salt
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    grouped = stash(own.join(groups, "node").withColumn("salt", salt))
    smallest = stash(grouped.groupBy("component").agg(F.min("own_id").alias("component_id")))
    dealt = stash(smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))))
    ids = grouped.join(dealt, ["component", "salt"]).select("node", "component_id")
    single = own.join(groups, "node", "left_anti").select("node", F.col("own_id").alias("component_id"))
    named = stash(ids.unionByName(single))
    rows = known.select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    return rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id (smallest doc_id reachable by links).

    Null, empty and blank texts have no shingle, no link and their own id as
    component. Equal texts are linked, repeated rows too. Rows with a null id
    take part; a component of such rows alone has a null id. Rows of one id with
    different texts are linked each by its own. Sets are named by 64-bit hashes,
    and so are the texts of one id. Very long texts are taken whole. An empty
    table gives an empty result; other columns of ``docs`` are ignored.
    """
    return _components_of_rows(docs).drop("text_hash")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id, with the columns they came with.

    Rows that repeat an id count once: of different texts the one with the
    smallest hash stays. Rows with a null id always stay.
    """
    kept = _components_of_rows(docs).filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    kept = stash(kept.groupBy("doc_id").agg(F.min(F.struct("text_hash", "times")).alias("row")).select(F.col("doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"), F.col("row.times").alias("_times")))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_own_hash"))
    if 48 * kept.count() <= BROADCAST_BYTES:
        kept = F.broadcast(kept)
    found = rows.join(kept, (F.col("_own") == F.col("_id")) & (F.col("_own_hash") == F.col("_hash")))
    # only rows that come again have to meet
    once = found.filter("_times = 1").unionByName(found.filter("_times > 1").dropDuplicates(["_own"]))
    return once.select("_doc.*").unionByName(docs.filter("doc_id is null"))
