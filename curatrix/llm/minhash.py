"""Near duplicates from min-hash keys, bottom-k sketches and lists over whole sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import forget_shuffles, id_and_text, map_texts, small_side, stored
from .wordhash import WHITE, WordHasher, byte_table, mixed

SHINGLE_WORDS = 5
#: Keys of a set, and least values under as many hash functions that make one key. Sets with a
#: similarity of 0.8 share no key with a chance of (1 - 0.8 ** 4) ** 48, about 1e-11; those of
#: 0.01, as texts of one language have here, share a given key with a chance of 1e-8.
KEYS, KEY_VALUES = 48, 4
#: Values kept of a set, and how many of them two similar sets must have in common at least.
#: For a true similarity of 0.8, 51 of 64 are common on average; that they are fewer than 27
#: has a chance of about 1e-9 (Chernoff). Sets of up to 64 shingles are kept whole.
SKETCH, SHARED = 64, 27
#: Members from which on an inverted list is replaced by lists over whole sets, and the
#: ratio of sizes between two size classes there.
LONG_LIST, SIZE_STEP = 32, 1.05
#: A family is dealt into parts of ``PART`` members up to ``PARTS`` parts, and of at most
#: ``LARGE_PART`` members or ``PART_BYTES`` of text beyond; two parts at a time are compared.
PART, PARTS, LARGE_PART, PART_BYTES = 256, 8, 4096, 4 << 20
#: Classes whose table takes up to so many bytes are broadcast to find their texts.
CHOSEN_BYTES = 16 << 20


def shingle_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int) -> set:
    """Distinct runs of ``width`` words; fewer words are one run; no words, none."""
    if not words:
        return set()
    return set(zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else {tuple(words)}


def hashed_shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of word hashes: the one hash function of the sketch."""
    width = min(width, len(h))
    out = np.full(max(0, len(h) - width + 1) if width else 0, np.uint64(width))
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers ``x`` and odd factors ``f`` of the functions (value ^ x) * f of 32 bits."""
    h = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64))
    x, f = (h >> np.uint64(32)).astype(np.uint32).reshape(2, count)
    return x, f | np.uint32(1)


def least_values(values: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of a set of 64-bit hashes under each function; stretches keep long sets small in memory."""
    x, f = functions
    least = np.full(len(f), 0xFFFFFFFF, np.uint32)
    upper = (values >> np.uint64(32)).astype(np.uint32)[:, None]
    for k in range(0, len(upper), 256):
        np.minimum(least, ((upper[k : k + 256] ^ x) * f).min(axis=0), out=least)
    return least


def keyed_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, n_shingles, set_id, keys); ``set_id`` is a 128-bit digest of the whole set."""

    def prepare():
        hasher = WordHasher(byte_table(WHITE, lower=True))
        functions = hash_functions(KEYS * KEY_VALUES)

        def work(texts: list) -> dict:
            hashes, counts = hasher([(t or "").encode("utf-8", "surrogatepass") for t in texts])
            sets = [hashed_shingles(h, width) for h in np.split(hashes, np.cumsum(counts)[:-1])]
            least = np.array([least_values(s, functions) for s in sets]).reshape(len(sets), KEYS, KEY_VALUES)
            keys = np.broadcast_to(np.arange(KEYS, dtype=np.uint64), (len(sets), KEYS))
            for k in range(KEY_VALUES):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
            return {
                "n_shingles": [len(s) for s in sets],
                "set_id": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "keys": pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * KEYS, keys.view(np.int64).ravel()),
            }

        return work

    return map_texts(docs, prepare, "n_shingles long, set_id binary, keys array<long>")


def short_sketches(bodies: DataFrame, width: int) -> DataFrame:
    """(class, sketch): upper halves of the ``SKETCH`` least hashes of each class, in the order of signed numbers."""

    def prepare():
        hasher = WordHasher(byte_table(WHITE, lower=True))

        def work(texts: list) -> dict:
            hashes, counts = hasher([t.encode("utf-8", "surrogatepass") for t in texts])
            sets = [hashed_shingles(h, width) for h in np.split(hashes, np.cumsum(counts)[:-1])]
            return {"sketch": [((s[:SKETCH] >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32) for s in sets]}

        return work

    return map_texts(bodies, prepare, "sketch array<int>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, rows: bool = False) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.8 or more.

    1. One pass makes ``KEYS`` keys of each set. Equal sets become one class.
    2. Lists hold the classes with a common key. A key stands for ``KEY_VALUES`` least values
       of the set under hash functions, so that sets with few common shingles seldom share
       one, however many classes there are and however frequent their shingles.
    3. Classes in lists of more than ``LONG_LIST`` members meet instead in lists over their
       whole sets, by pairs of size classes: there the least overlap of similar sets is
       exact, and only the few rarest shingles of a set can be the first common one.
    4. Each class is compared with the most common class near it, which links most groups.
    5. Lists that are still long share most of their members with one another. They are
       merged to families, by the class that step 4 compared most of their members with, so
       that two classes meet once in a family and not in each list. A family is dealt into
       parts, and each task compares the whole sets of two parts (see ``_family_links``).
    6. Rounds over the short lists: in each list some classes are pivots and are compared
       with the members that are not yet in their component. The sketch of the union
       estimates the similarity; pairs that can reach 0.8 are confirmed on the full texts.
       Pivots leave their lists, and are not taken from a list's largest component, since
       each open pair has a member outside it; those with most common keys come first.
       A list ends when all its members are in one component.

    No link between components is lost. Copies that their original links cost one comparison
    each. Those of a family that stay outside its largest component must be compared with
    all of it; no row is made of such a pair, but the work grows with their product.

    Returns per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id that is
    reachable), ``kept``; with ``rows`` also ``row`` (xxhash64 of the text), which tells texts
    of one id apart, and ``component`` (null for an empty set), which tells components apart.

    * Null, empty and blank texts have an empty set and are linked with nothing.
    * Rows repeated under one id are classes of that id; a null id is never a component id
      unless its whole component has none, and is kept only then.
    * An empty table gives an empty result. Other columns are ignored.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    marked = stored(keyed_sets(texts, width), "sketches")
    classes = marked.filter("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "row")).alias("member"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")
    )
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    links = _linked(texts, classes, _key_lists(classes), width)
    groups = classes.select("set_id", "class", "first_id").join(links, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(groups.join(lowest, "component").select("set_id", "component_id", "component"), "components")
    more = ["row", "component"] if rows else []
    linked = marked.filter("n_shingles > 0").join(named, "set_id").select("doc_id", "n_shingles", "component_id", *more)
    alone = marked.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("long").alias("component"))
    both = linked.unionByName(alone.select(linked.columns))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _key_lists(classes: DataFrame) -> DataFrame:
    """(value, class, n, size): the keys that several classes have, and how many those are."""
    posts = classes.select("class", "n", F.explode("keys").alias("value"))
    counts = stored(posts.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "values")
    return stored(posts.join(counts, "value"), "lists")


def _whole_set_lists(hot: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """(value, class, n): lists over the whole sets of the classes in long lists."""

    def shingles(batches):
        hasher = WordHasher(byte_table(WHITE, lower=True))
        for batch in batches:
            for ident, text in zip(batch.column("class"), batch.column("text"), strict=True):
                found = hashed_shingles(hasher([text.as_py().encode("utf-8", "surrogatepass")])[0], width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ident.as_py())), pa.array(np.full(len(found), len(found))), pa.array(found)], names=["class", "n", "value"])

    posts = stored(bodies.join(hot, "class").dropDuplicates(["class"]).mapInArrow(shingles, "class long, n long, value long"), "shingles")
    counts = stored(posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "values")
    common = posts.join(counts, "value").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    size_class = lambda n: F.floor(F.log(n) / float(np.log(SIZE_STEP))).cast("int")
    spread = common.withColumn("own", size_class(F.col("n"))).withColumn("other", F.explode(F.sequence(size_class(F.ceil(F.col("n") * 8 / 10)), size_class(F.floor(F.col("n") * 10 / 8)))))
    smallest = F.greatest(F.ceil(F.col("n") * 8 / 10), F.floor(F.pow(F.lit(SIZE_STEP), F.col("other")) - 1e-6))
    # sets of n and m shingles with a similarity of 0.8 share 4 / 9 of n + m at least, and 0.8 of the larger
    overlap = F.greatest(F.ceil((F.col("n") + smallest) * 4 / 9 - 1e-9), F.ceil(F.greatest("n", smallest) * 8 / 10 - 1e-9))
    indexed = F.greatest(F.lit(0), F.size("common") - overlap + 1).cast("int")
    rare = spread.select("class", "n", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.explode(F.slice("common", F.lit(1), indexed)).alias("c"))
    return rare.select(F.xxhash64("c.value", "low", "high").alias("value"), "class", "n")


def _linked(texts, classes, lists, width) -> DataFrame:
    """(class, component) of the classes that have a link."""
    # keys in common with all other classes: most for the original of many near copies
    shared = stored(lists.groupBy("class").agg(F.sum("size").alias("shared"), (F.max("size") > LONG_LIST).alias("hot")), "shared")
    bodies = _bodies(texts, classes.join(shared, "class"))
    short_lists = lists.filter(F.col("size") <= LONG_LIST).join(shared, "class")
    # the lists over whole sets have each pair of hot classes that can be similar
    other = short_lists.groupBy("value").agg(F.min("hot").alias("hot")).filter("not hot").select("value")
    whole = _whole_set_lists(shared.filter("hot").select("class"), bodies, width).join(shared, "class")
    members = short_lists.join(other, "value", "left_semi").select("value", "class", "n", "shared").unionByName(whole.select("value", "class", "n", "shared"))
    members = stored(members.withColumn("component", F.col("class")), "lists")
    short = stored(short_sketches(bodies, width).dropDuplicates(["class"]), "short")
    none = texts.sparkSession.createDataFrame([], "class long, component long")
    hubs = _hubs(members)
    forget_shuffles(texts.sparkSession)
    labels = _relabelled(none, _confirmed(_estimated(_hub_pairs(hubs), short), bodies, width))
    long = stored(members.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > LONG_LIST).select("value"), "long")
    labels = _relabelled(labels, _confirmed(_family_links(_families(members.join(long, "value", "left_semi"), hubs), labels, bodies, width), bodies, width))
    per_list = 1
    members = _unfinished(_marked(members.join(long, "value", "left_anti").drop("component"), labels))
    while not members.isEmpty():
        pivots = _pivots(members, per_list)
        pairs = members.join(pivots, "value").filter("component <> pivot_component and 5 * least(n, pivot_n) >= 4 * greatest(n, pivot_n)")
        pairs = stored(pairs.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct(), "pairs")
        labels = _relabelled(labels, _confirmed(_estimated(pairs, short), bodies, width))
        rest = members.join(pivots.select("value", F.col("pivot").alias("class")), ["value", "class"], "left_anti").drop("component")
        members = _unfinished(_marked(rest, labels))
        forget_shuffles(texts.sparkSession)
        per_list *= 8
    return labels


def _hubs(members: DataFrame) -> DataFrame:
    """(class, n, hub): each class and the most common class in its lists or in theirs.

    The original of many near copies is the one with most keys in common, but each copy
    shares only some lists with it; so the best class of a list goes to its members, and
    from there once more to their lists. One comparison a class links most of a group.
    """
    best = members.groupBy("value").agg(F.max(F.struct("shared", "class", "n")).alias("hub"))
    for _ in range(2):
        of_class = members.select("value", "class", "n").join(best, "value").groupBy("class", "n").agg(F.max("hub").alias("hub"))
        of_class = stored(of_class, "hubs")
        best = members.select("value", "class").join(of_class.select("class", "hub"), "class").groupBy("value").agg(F.max("hub").alias("hub"))
    return of_class


def _hub_pairs(hubs: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class and its hub."""
    near = hubs.filter("class <> hub.class and 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    return stored(near.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct(), "pairs")


def _families(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """(family, class): the lists of ``members`` merged by the most frequent hub in each; all members of a list are in its family."""
    placed = members.select("value", "class").join(hubs.select("class", F.col("hub.class").alias("hub")), "class")
    counts = placed.groupBy("value", "hub").agg(F.count(F.lit(1)).alias("n"))
    names = counts.groupBy("value").agg(F.max_by("hub", F.struct("n", "hub")).alias("family"))
    return stored(members.select("value", "class").join(names, "value").select("family", "class").distinct(), "families")


def _family_links(families: DataFrame, labels: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """Links (a, b) that connect the components of each family, found on whole sets.

    Only classes outside a family's largest component are compared with others, since each
    open pair has one. A family's members are dealt into parts by hash, and each pair of
    parts is a group of its own, which bounds what a task holds. Of the links of a group
    only those are returned that join components, so there are fewer than members.
    """
    marked = stored(families.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class")), "members")
    parts = marked.groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"))
    top = stored(parts.groupBy("family").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("several"), F.sum("size").alias("members")).filter("several > 1"), "open")
    texts = _texts_of(marked.select("class").distinct(), bodies)
    rows = stored(marked.join(small_side(top), "family").join(texts, "class").select("family", "members", "class", "component", (F.col("component") != F.col("top.component")).alias("outer"), "text"), "members")
    heavy = small_side(stored(rows.groupBy("family").agg(F.sum(F.octet_length("text")).alias("bytes")), "heavy"))
    by_count = F.greatest(F.least(F.ceil(F.col("members") / PART), F.lit(PARTS)), F.ceil(F.col("members") / LARGE_PART))
    dealt = rows.join(heavy, "family").withColumn("parts", F.greatest(by_count, F.ceil(F.col("bytes") / PART_BYTES)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(2), "class"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = dealt.select("family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "class", "component", "outer", "text")

    def run(table: pa.Table) -> pa.Table:
        hasher = WordHasher(byte_table(WHITE, lower=True))
        sets = [hashed_shingles(hasher([t.as_py().encode("utf-8", "surrogatepass")])[0], width) for t in table.column("text")]
        names, component, part = (table.column(c).to_numpy() for c in ("class", "component", "part"))
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        found = joining_links(sets, names, component, outer, part, part.min() != part.max())
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])

    # the parts of a family would stay in one task where its rows already lie by family
    found = tiles.repartition("family", "low", "high").groupBy("family", "low", "high").applyInArrow(run, "a long, b long")
    return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def joining_links(sets: list[np.ndarray], names: np.ndarray, component: np.ndarray, outer: np.ndarray, part: np.ndarray, across: bool) -> list[tuple]:
    """Pairs of names whose sets have a Jaccard similarity of 0.8, as far as they join components.

    Each set that is ``outer`` is compared with all sets of a similar size; ``across``
    leaves out those of its own part.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, names, component, outer, part = [sets[k] for k in order], names[order], component[order], outer[order], part[order]
    n = np.array([len(s) for s in sets])
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.append(0, np.cumsum(n))
    held = np.zeros(values.max() + 1, np.uint8)
    parent = {c: c for c in component.tolist()}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for k in np.flatnonzero(outer):
        first, last = np.searchsorted(5 * n, 4 * n[k]), np.searchsorted(4 * n, 5 * n[k], side="right")
        own = values[begins[k] : begins[k + 1]]
        held[own] = 1
        both = np.add.reduceat(held[values[begins[first] : begins[last]]], begins[first:last] - begins[first], dtype=np.int64)
        held[own] = 0
        near = 100 * both >= 80 * (n[first:last] + n[k] - both)
        if across:
            near &= part[first:last] != part[k]
        met = np.flatnonzero(near) + first
        for m in met[np.unique(component[met], return_index=True)[1]].tolist():
            x, y = root(int(component[k])), root(int(component[m]))
            if x != y:
                parent[x] = y
                found.append((int(names[k]), int(names[m])))
    return found


def _marked(members: DataFrame, labels: DataFrame) -> DataFrame:
    return stored(members.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class")), "lists")


def _unfinished(members: DataFrame) -> DataFrame:
    """Members of the lists that still have several components."""
    several = members.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("value")
    return stored(members.join(stored(several, "values"), "value"), "lists")


def _pivots(members: DataFrame, per_list: int) -> DataFrame:
    """Up to ``per_list`` members of each list, outside its largest component if that has several."""
    parts = members.groupBy("value", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = stored(parts.groupBy("value").agg(F.max(F.struct("size", "component")).alias("top")).filter("top.size > 1").select("value", F.col("top.component").alias("_largest")), "largest")
    small = members.join(largest, "value", "left").filter("_largest is null or component <> _largest")
    slot = F.pmod(F.xxhash64(F.lit(1), "class"), F.lit(per_list)).alias("_slot")
    picked = small.groupBy("value", slot).agg(F.max(F.struct("shared", F.xxhash64("class"), "class", "component", "n")).alias("p"))
    return stored(picked.select("value", F.col("p.class").alias("pivot"), F.col("p.component").alias("pivot_component"), F.col("p.n").alias("pivot_n")), "pivots")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` (a, b) between classes; only components that meet are worked on."""
    known = lambda side: labels.select(F.col("class").alias(side), F.col("component").alias(f"_{side}"))
    met = links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = stored(connected_components(met, "a", "b").select(F.col("id").alias("_id"), F.col("component").alias("_to")), "merged")
    moved = labels.join(merged, labels["component"] == merged["_id"], "left").select("class", F.coalesce("_to", "component").alias("component"))
    fresh = merged.join(labels, merged["_id"] == labels["class"], "left_anti").select(F.col("_id").alias("class"), F.col("_to").alias("component"))
    both = stored(moved.unionByName(fresh), "labels")
    forget_shuffles(both.sparkSession)
    return both


def _bodies(texts, needed) -> DataFrame:
    """(class, text) of one member of each needed class; of all texts only theirs are shuffled unless those classes are very many."""
    chosen = stored(needed.select("class", F.col("member.doc_id").alias("id"), F.col("member.row").alias("r")), "needed")
    marks = stored(chosen.select(F.xxhash64("id", "r").alias("mark")).distinct(), "marks")
    few = small_side(marks, CHOSEN_BYTES)
    if few is not marks:
        texts = texts.join(few, F.xxhash64("doc_id", "row") == F.col("mark"), "left_semi")
    return stored(texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["id"]) & (texts["row"] == chosen["r"])).select("class", "text"), "texts")


def _texts_of(chosen: DataFrame, bodies: DataFrame) -> DataFrame:
    """The rows of ``bodies`` whose class is among ``chosen``, without a shuffle of all texts unless those classes are very many."""
    chosen = stored(chosen, "chosen")
    few = small_side(chosen, CHOSEN_BYTES)
    return bodies if few is chosen else stored(bodies.join(few, "class", "left_semi"), "texts")


def _estimated(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs that the sketch of the union leaves possible.

    The smallest values of the union are a random sample of it; of those, similar sets
    share ``SHARED`` of ``SKETCH`` at least (see there). The upper halves of the values do.
    """
    a = short.select(F.col("class").alias("a"), F.col("sketch").alias("s_a"))
    b = short.select(F.col("class").alias("b"), F.col("sketch").alias("s_b"))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
    agreed = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    return pairs.join(a, "a").join(b, "b").filter(agreed * SKETCH >= SHARED * F.size(union)).select("a", "b")


def _confirmed(pairs: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """Pairs whose exact shingle sets reach the similarity."""
    pairs = stored(pairs, "possible")
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), bodies)
    a, b = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, last_set = None, None
        for batch in batches:
            flags = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                y = y.as_py()
                if y != last:
                    last, last_set = y, shingle_set(shingle_words(y), width)
                one = shingle_set(shingle_words(x.as_py()), width)
                both = len(one & last_set)
                flags.append(100 * both >= 80 * (len(one) + len(last_set) - both))
            yield batch.select(["a", "b"]).filter(pa.array(flags, pa.bool_()))

    return stored(joined.mapInArrow(run, "a long, b long"), "links")
