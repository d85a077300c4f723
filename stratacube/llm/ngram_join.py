"""N-gram Jaccard join: documents grouped by identical prefix and size, group pairs filtered, members verified.

The global shingle order of the prefix filter is (frequent last, hash): any total order is right, and this one
needs counts of prefix shingles only, a tenth of all shingles, instead of a count of every shingle of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from stratacube.llm import textbuf as tb
from stratacube.operators.graph import connected_components
from stratacube.sources.workspace import Workspace

#: A shingle in the extended prefix of this many groups comes last in the order.  It moves work, never results.
FREQUENT = 128
#: Marks a frequent shingle among 62-bit hashes, so that natural order is the global order.
HOT_BIT = 1 << 62
#: So many frequent shingles, eight bytes each, are handed to every task; more of them are joined.
MOST_FREQUENT = 1 << 20
#: Seats of a shingle that each of its seats meets in the second round.
CENTRES = 16
#: Places of the short form of a set's parity bitmap, as columns of 64; the bitmap itself has twice as many places as the set members.
BITS = 512
_MAPS = [f"b{i}" for i in range(BITS // 64)]
#: Classes and shingles of one block of a component whose links are counted; larger components are several blocks.
LINK_SETS, LINK_SHINGLES = 512, 1 << 17


def prefix_length(n, num: int, den: int):
    """A set of n and one at least as similar as num / den share a member among their first this many; n at most."""
    return n - (num * n + den - 1) // den + 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int):
    """Sorted distinct 62-bit shingle hashes of each row; the whole word sequence where a row has fewer words."""
    data = tb.LOWER[data]
    start, end, row = tb.words(data, offs)
    h = tb.span_hash(tb.prefix_hash(data), start, end)
    first = np.searchsorted(row, np.arange(len(offs)))
    m = max(0, len(h) - width + 1)
    whole = h[:m].copy()
    for k in range(1, width):
        whole = tb.mix(whole * np.uint64(31) + h[k : k + m])
    whole >>= np.uint64(2)
    for i in range(len(offs) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif b > a:
            s = h[a : a + 1].copy()
            for k in range(a + 1, b):
                s = tb.mix(s * np.uint64(31) + h[k : k + 1])
            yield tb.mix(s + np.uint64(b - a)) >> np.uint64(2)
        else:
            yield h[:0]


def _set_keys(s: np.ndarray) -> tuple[int, int]:
    mixed = tb.mix(s + np.uint64(1))
    return int(mixed.sum(dtype=np.uint64).view(np.int64)), int((np.bitwise_xor.reduce(mixed) if len(s) else np.uint64(0)).view(np.int64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the members at each of twice as many places, a power of two: two sets differ in at least as many members as their bitmaps in bits."""
    places = max(BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else BITS
    odd = np.bincount((tb.mix(s + np.uint64(7)) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(bitmap: np.ndarray, longs: int) -> np.ndarray:
    """The bitmap over fewer places."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, longs), axis=0)


def _list_of_longs(parts: list[np.ndarray]) -> pa.Array:
    lengths = np.fromiter((len(p) for p in parts), dtype=np.int32, count=len(parts))
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


def _maps(sets: list[np.ndarray], wanted: bool) -> list[pa.Array]:
    if not wanted:
        return []
    wide = [_bitmap(s) for s in sets]
    table = np.array([_folded(w, len(_MAPS)) for w in wide]).reshape(len(sets), len(_MAPS))
    return [*(pa.array(np.ascontiguousarray(c)) for c in table.T), _list_of_longs(wide)]


def _shingled(docs: DataFrame, text_col: str, id_col: str, width: int, keep, maps: bool = False) -> DataFrame:
    """(id, text_hash, n, key1, key2, shingles, if wanted the bitmap and a short form of it in columns): ``keep(n)`` smallest hashes of each document's set, in order."""

    def run(batches):
        for batch in batches:
            for r0, r1, data, offs in tb.slices(batch.column(2)):
                sets = list(shingle_sets(data, offs, width))
                keys = [_set_keys(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(r0, r1 - r0), batch.column(1).slice(r0, r1 - r0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _list_of_longs([s[: keep(len(s))] for s in sets]), *_maps(sets, maps)],
                    ["id", "text_hash", "n", "key1", "key2", "shingles", *([*_MAPS, "wide"] if maps else [])],
                )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(tb.frugal(run), "id long, text_hash long, n long, key1 long, key2 long, shingles array<long>" + ("".join(f", {c} long" for c in _MAPS) + ", wide array<long>" if maps else ""))


def _in_order(rows: DataFrame, frequent: DataFrame, num: int, den: int) -> DataFrame:
    """``rows`` with ``prefix``, the first shingles in the global order, for ``shingles``; ``enough``: none of a rarer one can be missing.

    Up to MOST_FREQUENT frequent shingles go to every task as one sorted array; more of them meet the rows in a join.
    """
    keep = [c for c in rows.columns if c != "shingles"]
    if frequent.limit(MOST_FREQUENT + 1).count() <= MOST_FREQUENT:
        common = rows.sparkSession.sparkContext.broadcast(np.sort(frequent.toArrow().column(0).to_numpy()))

        def run(batches):
            for batch in batches:
                lists = batch.column(batch.schema.names.index("shingles"))
                offs = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.values.to_numpy()[offs[0] : offs[-1]]
                size = np.diff(offs)
                n = batch.column(batch.schema.names.index("n")).to_numpy()
                p = prefix_length(n, num, den)
                row = np.repeat(np.arange(len(size)), size)
                at = np.minimum(np.searchsorted(common.value, flat), max(0, len(common.value) - 1))
                hot = common.value[at] == flat if len(common.value) else np.zeros(len(flat), bool)
                order = np.argsort(row * 2 + hot, kind="stable")
                token = np.where(hot, flat + HOT_BIT, flat)[order]
                rare = size - np.bincount(row[hot], minlength=len(size))
                first = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)) < np.repeat(p, size)
                cut = np.r_[0, np.cumsum(np.minimum(size, p))].astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(cut), pa.array(token[first]))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in keep] + [prefix, pa.array((rare >= p) | (size >= n))], [*keep, "prefix", "enough"])

        return rows.mapInArrow(tb.frugal(run), rows.select(*keep).schema.add("prefix", ArrayType(LongType())).add("enough", "boolean"))
    key = ["n", "key1", "key2"]
    hits = rows.select(*key, F.explode("shingles").alias("token")).join(frequent, "token").groupBy(*key).agg(F.collect_set("token").alias("hot"))
    p = F.expr(f"n - (({num} * n + {den - 1}) div {den}) + 1").cast("int")
    split = rows.join(hits, key, "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<long>")))
    rare = F.array_except("shingles", "hot")
    last = F.transform(F.array_sort(F.array_intersect("shingles", "hot")), lambda x: x + F.lit(HOT_BIT))
    return split.select(*keep, F.slice(F.concat(rare, last), F.lit(1), p).alias("prefix"), ((F.size(rare) >= p) | (F.size("shingles") >= F.col("n"))).alias("enough"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100, count_links: bool = False) -> DataFrame:
    """Link documents whose distinct word shingles have Jaccard similarity >= num / den.

    Returns (id, n_shingles, component_id, class_id, component, text_hash), one row per input row; component_id is the
    smallest id reachable by links, class_id the smallest of an equal set, component is common to linked classes (both
    null without shingles), text_hash tells rows of one id apart.  With ``count_links`` there is n_links too, the number
    of other rows that the row is linked with, those of an equal set included; 0 without shingles.  Words are runs of non-blank bytes after lowering A-Z.
    Null, empty and blank texts have no shingles and link with nothing.  Repeated rows and equal sets are one class from the start, so a group of
    copies costs one row per class.  A row without id links like any other and names no component.  Only the named
    columns are read, whatever else the table holds.

    Classes of identical prefix and size form a group.  Group pairs come from shared prefix shingles in three
    rounds: (1) every group with a centre of its size band under each of its shingles; the pairs left by the
    filters are expanded, verified and joined into components; (2) groups are expanded, and under each shingle that
    still sees several components every member meets about CENTRES others, which is all of them where the shingle has
    no more; (3) under the shingles with more, members outside the largest component meet all members of another.
    Pairs inside a component are not formed there: they cannot change one.  Where links are counted, the classes of each
    component are compared with each other once it is known (``_linked_rows``).  Filters use sizes, positions and a lower
    bound of the difference from parity bitmaps (inside the join, before a pair becomes a row); none loses a link.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram")
    p = lambda n: prefix_length(n, num, den)
    plen = F.expr(f"n - (({num} * n + {den - 1}) div {den}) + 1").cast("int")
    cid = F.xxhash64("n", "key1", "key2").alias("cid")
    gid = F.xxhash64("n", "prefix").alias("gid")
    sigs = ws.save(_shingled(docs, text_col, id_col, width, lambda n: min(n, p(n) + p(n) // 2 + 8) if n else 0, maps=True), "sigs")
    keys = ws.save(sigs.select("id", "text_hash", "n", F.when(F.col("n") > 0, cid).alias("cid")), "keys")
    counted = sigs.where("n > 0").select(F.explode(F.slice("shingles", F.lit(1), plen)).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    frequent = ws.save(counted.where(f"c >= {FREQUENT}").select("token"), "frequent")
    placed = _in_order(sigs.where("n > 0"), frequent, num, den)
    classes = ws.save(placed.groupBy("n", "key1", "key2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("rep"), *(F.first(c).alias(c) for c in ("prefix", "enough", *_MAPS, "wide")), F.count("*").alias("rows")).select(cid, gid, "n", "rows", F.col("rep.id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), "prefix", "enough", *_MAPS, "wide"), "classes")
    ws.drop("sigs")
    reps = ws.save(classes.select("cid", "n", "rows", "rep", "rep_hash", *_MAPS), "reps")
    bitmaps = ws.save(classes.select("cid", "n", "wide"), "bitmaps")
    # the few documents made mostly of frequent shingles are read again for their whole sets
    short = ws.save(classes.where("NOT enough").select("cid", "rep", "rep_hash"), "short")
    again = _in_order(_sets(docs, short, id_col, text_col, width, maps=True), frequent, num, den)
    whole = classes.where("enough").select("cid", "gid", "n", "prefix", *_MAPS).unionByName(again.select("cid", gid, "n", "prefix", *_MAPS))
    members = whole.select("gid", "cid", "n")
    # a group's bitmap is that of its head; no member is further from it than the radius, the places where any two members differ
    spread = " + ".join(f"bit_count(or_{c} ^ and_{c})" for c in _MAPS)
    groups = whole.groupBy("gid").agg(F.min(F.struct("cid", *_MAPS)).alias("head"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("size"), *(f(c).alias(f"{name}_{c}") for c in _MAPS for name, f in (("or", F.bit_or), ("and", F.bit_and))))
    groups = ws.save(groups.select("gid", F.col("head.cid").alias("head"), "n", "prefix", "size", F.expr(spread).alias("radius"), *(F.col(f"head.{c}").alias(c) for c in _MAPS)), "groups")
    members = ws.save(members, "members")
    heads = ws.save(groups.drop("prefix"), "heads")
    ws.drop("classes", "short")
    entries = groups.select("gid", "size", "n", F.posexplode("prefix").alias("pos", "token"))
    # frequent shingles are few and may be hot: they are kept without a look at their group; of the others only those that two classes share
    rare = entries.where(F.col("token") < HOT_BIT).withColumn("c", F.sum("size").over(Window.partitionBy("token"))).where("c > 1")
    # similar sizes are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num) if num < den else 1e-3))).cast("int")
    entries = ws.save(rare.drop("size").unionByName(entries.where(F.col("token") >= HOT_BIT).drop("size").withColumn("c", F.lit(None).cast("long"))).withColumn("band", band), "entries")
    ws.drop("groups")

    near = "{d} * least(n1, n2) >= {n} * greatest(n1, n2)".format(n=num, d=den)
    # before the first shared shingle nothing is shared, so min(n1 - p1, n2 - p2) bounds the intersection
    room = "({n} + {d}) * least(n1 - p1, n2 - p2) >= {n} * (n1 + n2)".format(n=num, d=den)
    bits = " + ".join(f"bit_count(x{c} ^ y{c})" for c in _MAPS)
    alike = lambda slack: f"({bits}{slack}) * {num + den} <= (n1 + n2) * {den - num}"
    x_map, y_map = [F.col(c).alias(f"x{c}") for c in _MAPS], [F.col(c).alias(f"y{c}") for c in _MAPS]

    # 1: stars. A shingle's centre in a size band is the group there with most in common, the likely source of the
    # others, whose edits make shingles of their own; a hot shingle costs one row per entry.
    common = entries.groupBy("gid").agg(F.count("*").alias("common"))
    centres = entries.join(common, "gid").groupBy("token", "band").agg(F.max(F.struct("common", "gid", "n", "pos")).alias("m")).select("token", "band", F.col("m.gid").alias("g2"), F.col("m.n").alias("n2"), F.col("m.pos").alias("p2"))
    around = entries.select("token", F.col("gid").alias("g1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    stars = around.join(centres, ["token", "band"]).where("g1 <> g2").where(near).where(room).select("g1", "g2").distinct()
    stars = stars.join(heads.select(F.col("gid").alias("g1"), F.col("n").alias("n1"), F.col("radius").alias("r1"), *x_map), "g1").join(heads.select(F.col("gid").alias("g2"), F.col("head").alias("c2"), F.col("n").alias("n2"), F.col("radius").alias("r2"), *y_map), "g2")
    stars = stars.where(near).where(alike(" - r1 - r2")).select("g1", "c2")
    star_pairs = stars.join(members.select(F.col("gid").alias("g1"), F.col("cid").alias("c1")), "g1").select("c1", "c2").unionByName(members.join(heads.where("size > 1").select("gid", "head"), "gid").where("cid <> head").select(F.col("cid").alias("c1"), F.col("head").alias("c2")))
    links, comp, sets = None, None, []

    def joined(found: DataFrame, name: str) -> None:
        """Verify pairs of classes and put what they link together."""
        nonlocal links, comp
        pairs = ws.save(_plausible(found, bitmaps, num, den), f"pairs{name}")
        if links is not None and pairs.isEmpty():
            return
        similar, compared = _verified(docs, pairs, reps, ws, name, id_col, text_col, width, num, den)
        more = ws.save(similar, f"links{name}")
        sets.append(compared)
        if links is not None and more.isEmpty():
            return
        links = more if links is None else links.unionByName(more)
        comp = connected_components(links, "c1", "c2")

    joined(star_pairs, "1")

    def mixed(seats: DataFrame, name: str) -> DataFrame:
        """Seats (token, cid, ...) under the shingles that see several components, with component, the largest one there and the number of seats."""
        seats = seats.join(comp.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        counts = seats.groupBy("token", "component").agg(F.count("*").alias("c"))
        tokens = counts.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts"), F.sum("c").alias("total")).where("parts > 1")
        return ws.save(seats.join(tokens.select("token", F.col("top.component").alias("top"), "total"), "token"), name)

    def sides(first: DataFrame, second: DataFrame) -> DataFrame:
        """Pairs of seats of one shingle and different components that no filter tells apart; members of one group meet under its first shingle."""
        one = first.select("token", F.col("gid").alias("g1"), F.col("cid").alias("c1"), F.col("component").alias("k1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("centre").alias("t1"), *x_map)
        two = second.select("token", F.col("gid").alias("g2"), F.col("cid").alias("c2"), F.col("component").alias("k2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("centre").alias("t2"), *y_map)
        return one.join(two, "token").where("k1 <> k2 AND (g1 <> g2 OR p1 = 0) AND NOT (t1 AND t2 AND c1 < c2)").where(near).where(room).where(alike("")).select("c1", "c2")

    # 2: every seat meets about CENTRES seats of its shingle, chosen by hash; the stars have compared all that only two classes share
    seats = entries.where("c IS NULL OR c > 2").select("token", "gid", "pos").join(members, "gid")
    centre = F.pmod(F.xxhash64("cid", "token"), F.col("total")) < CENTRES
    open_ = mixed(seats, "open2").join(reps.select("cid", *_MAPS), "cid").withColumn("centre", centre)
    joined(sides(open_, open_.where("centre")), "2")
    ws.drop("entries")

    # 3: all that is left apart under shingles with more seats
    wide = ws.load("open2", open_.select("token", "cid", "gid", "pos", "n", "component", "top", "total")).where(F.col("total") > CENTRES).select("token", "cid", "gid", "pos", "n")
    last = mixed(wide, "open3").join(reps.select("cid", *_MAPS), "cid").withColumn("centre", F.expr("component <> top"))
    joined(sides(last.where("centre"), last), "3")
    ws.drop("open2")

    named = reps.select("cid", "rep").join(comp.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    by_class = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("cid", "rep", "component", "component_id")
    if count_links:
        linked = _linked_rows(sets, comp, reps, num, den)
        by_class = by_class.join(reps.select("cid", "rows"), "cid").join(linked, "cid", "left").withColumn("n_links", F.col("rows") - 1 + F.coalesce("linked", F.lit(0)))
    out = keys.join(by_class, "cid", "left")
    counts = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("rep").alias("class_id"), "component", "text_hash", *counts)


def _shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many members each set of ``x`` has in common with each of ``y``; a side is the members, set after set, and the sets' sizes."""
    both = np.intersect1d(x[0], y[0])
    out = np.zeros((len(x[1]), len(y[1])))
    sides = []
    for members, sizes in (x, y):
        at = np.minimum(np.searchsorted(both, members), max(0, len(both) - 1))
        known = both[at] == members if len(both) else np.zeros(len(members), bool)
        by = np.argsort(at[known], kind="stable")
        sides.append((at[known][by], np.repeat(np.arange(len(sizes)), sizes)[known][by], len(sizes)))
    step = 1 << 13
    for a in range(0, len(both), step):
        tables = []
        for at, row, n in sides:
            i, j = np.searchsorted(at, (a, a + step))
            table = np.zeros((n, min(step, len(both) - a)), np.float32)
            table[row[i:j], at[i:j] - a] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _linked_rows(sets: list[DataFrame], comp: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """(cid, linked): the rows of all other classes that a class is linked with.

    Links lie inside components, and both ends of each were compared in some round, so ``sets`` has the whole sets of
    every class of a component.  A component of at most LINK_SETS classes and LINK_SHINGLES shingles is one block.  Of a
    larger one each band of set sizes is dealt into blocks of about that size by hash, and a task compares one block with
    itself, with another of its band or with one of the next band; further apart no sizes can link.  What a task holds is
    bounded by two blocks and their longest text; only counts leave it, never pairs.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists, side = group.column("shingles").combine_chunks(), group.column("side").to_numpy()
        offs, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        cid, rows = group.column("cid").to_numpy(), group.column("rows").to_numpy()
        blocks = []
        for s in (0, 1):
            of = np.flatnonzero(side == s)
            parts = [flat[offs[i] : offs[i + 1]] for i in of]
            blocks.append((of, (np.concatenate(parts) if parts else flat[:0], np.array([len(p) for p in parts], np.int64))))
        alone = group.column("alone")[0].as_py()
        (a, x), (b, y) = blocks[0], blocks[0 if alone else 1]
        k = _shared(x, y)
        linked = den * k >= num * (x[1][:, None] + y[1][None, :] - k)
        if alone:
            np.fill_diagonal(linked, False)
            return pa.table({"cid": cid[a], "linked": linked @ rows[a]})
        return pa.table({"cid": np.r_[cid[a], cid[b]], "linked": np.r_[linked @ rows[b], linked.T @ rows[a]]})

    whole = sets[0]
    for more in sets[1:]:
        whole = whole.unionByName(more.join(whole.select("cid"), "cid", "left_anti"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num) if num < den else 1e-3))).cast("int")
    seats = comp.select(F.col("id").alias("cid"), "component").join(reps.select("cid", "n", "rows"), "cid").withColumn("band", band)
    bands = seats.groupBy("component", "band").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    all_, next_ = Window.partitionBy("component"), Window.partitionBy("component").orderBy("band")
    bands = bands.withColumn("one", (F.sum("c").over(all_) <= LINK_SETS) & (F.sum("s").over(all_) <= LINK_SHINGLES))
    bands = bands.withColumn("k", F.when(F.col("one"), 1).otherwise(F.greatest(F.ceil(F.col("c") / LINK_SETS), F.ceil(F.col("s") / LINK_SHINGLES))).cast("int"))
    beside = lambda f, by: F.coalesce(F.when(~F.col("one") & (f("band").over(next_) == F.col("band") + by), f("k").over(next_)), F.lit(0))
    bands = bands.select("component", "band", "one", "k", beside(F.lead, 1).alias("up"), beside(F.lag, -1).alias("down"))
    placed = seats.join(bands, ["component", "band"]).withColumn("band", F.when(F.col("one"), 0).otherwise(F.col("band")))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    cells = F.expr("""concat(
        transform(sequence(0, k - 1), l -> named_struct('low', band, 'high', band, 'i', least(own, l), 'j', greatest(own, l), 'side', int(own > l), 'alone', own = l)),
        transform(filter(sequence(0, greatest(up - 1, 0)), l -> up > 0), l -> named_struct('low', band, 'high', band + 1, 'i', own, 'j', l, 'side', 0, 'alone', false)),
        transform(filter(sequence(0, greatest(down - 1, 0)), l -> down > 0), l -> named_struct('low', band - 1, 'high', band, 'i', l, 'j', own, 'side', 1, 'alone', false)))""")
    dealt = placed.select("cid", "component", "rows", cells.alias("cells")).join(whole.select("cid", "shingles"), "cid").select("cid", "component", "rows", "shingles", F.explode("cells").alias("cell"))
    key = ["component", "low", "high", "i", "j"]
    dealt = dealt.select("component", *(F.col(f"cell.{c}").alias(c) for c in (*key[1:], "side", "alone")), "cid", "rows", "shingles")
    return dealt.groupBy(*key).applyInArrow(run, "cid long, linked long").groupBy("cid").agg(F.sum("linked").alias("linked"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, without all but one document of each component.

    The one with the smallest id stays, one without id only where none has one.  Rows are told apart by id and
    text: rows of one id with different texts are decided each by itself, and a row that repeats another is
    its copy.  Null, empty and blank texts have no shingles and all stay.
    """
    found = Workspace(docs.sparkSession, "near").save(ngram_components(docs, id_col, text_col, width, num, den), "found")
    own, one, same = (tb.unused(n, docs.columns) for n in ("__own", "__id", "__hash"))
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("m"))
    stay = first.select(F.col("m.id").alias(one), F.col("m.text_hash").alias(same)).unionByName(found.where("component IS NULL").select(F.col("id").alias(one), F.col("text_hash").alias(same)).distinct())
    out = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    out = out.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(one)) & (F.col(own) == F.col(same)), "left_semi")
    repeated = found.where("component IS NOT NULL").groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeated:
        return out.drop(own)
    bare = F.regexp_replace(F.col(text_col).cast("string"), "[ \\t-\\r]", "") == ""
    empty = F.col(text_col).isNull() | bare
    return out.where(empty).unionByName(out.where(~empty).dropDuplicates([id_col, own])).drop(own)


def _plausible(pairs: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (c1, c2), c1 < c2, whose whole bitmaps do not show too large a difference."""

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            lists = []
            for c in (4, 5):
                offs = batch.column(c).offsets.to_numpy()
                lists.append((batch.column(c).values.to_numpy(), offs[:-1].tolist(), offs[1:].tolist()))
            (x, xa, xb), (y, ya, yb) = lists
            least = np.zeros(len(n), np.int64)
            for i in range(len(n)):
                longs = min(xb[i] - xa[i], yb[i] - ya[i])
                least[i] = np.bitwise_count((_folded(x[xa[i] : xb[i]], longs) ^ _folded(y[ya[i] : yb[i]], longs)).view(np.uint64)).sum()
            yield batch.select([0, 1]).filter(pa.array(least * (num + den) <= n * (den - num)))

    distinct = pairs.where("c1 <> c2").select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct()
    both = distinct.join(bitmaps.select(F.col("cid").alias("c1"), F.col("n").alias("n1"), F.col("wide").alias("x")), "c1").join(bitmaps.select(F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("wide").alias("y")), "c2")
    return both.where(f"{den} * least(n1, n2) >= {num} * greatest(n1, n2)").select("c1", "c2", "n1", "n2", "x", "y").mapInArrow(tb.frugal(run), "c1 long, c2 long")


def _sets(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, width: int, maps: bool = False) -> DataFrame:
    """Rows of ``_shingled`` with cid: whole sets of the classes in ``asked`` (cid, rep, rep_hash), made again from the texts of their representatives."""
    text = F.col(text_col).cast("string")
    wanted = asked.select("rep", "rep_hash").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("own")).join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("rep_hash")), "left_semi")
    sets = _shingled(texts, "text", "id", width, lambda n: n, maps).withColumn("cid", F.xxhash64("n", "key1", "key2"))
    return sets.join(asked.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, ws: Workspace, name: str, id_col: str, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The pairs whose whole sets are similar enough; the sets of all the pairs' classes."""
    asked = pairs.select(F.col("c1").alias("cid")).union(pairs.select("c2")).distinct().join(reps.select("cid", "rep", "rep_hash"), "cid")
    sets = ws.save(_sets(docs, asked, id_col, text_col, width).select("cid", "n", "shingles"), f"sets{name}")
    one = sets.select(F.col("cid").alias("c1"), F.col("n").alias("n1"), F.col("shingles").alias("s1"))
    two = sets.select(F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("shingles").alias("s2"))
    both = pairs.join(one, "c1").join(two, "c2").where(f"{den} * least(n1, n2) >= {num} * greatest(n1, n2)").withColumn("shared", F.size(F.array_intersect("s1", "s2")))
    return both.where(f"{den} * shared >= {num} * (n1 + n2 - shared)").select("c1", "c2"), sets
