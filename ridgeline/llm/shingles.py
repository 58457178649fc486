"""Near-deduplication by the Jaccard similarity of word shingles.

Candidates are sets of shingles whose SimHash fingerprints the tries of ``simhash`` connect within 6 bits. Sets of
similarity 0.8 may differ in more bits, and wider budgets cost too much, so there is an exact way for the rest: sets that
the tries leave apart are candidates too if they have the same smallest hashes in one of 40 bands of four hash functions.
Two sets of similarity 0.8 share no band in one of 10**9 cases, more similar ones still more rarely. A candidate counts
only if the similarity of the whole texts reaches the limit. In each group of candidates the smallest set is compared
with all others first. Most groups are connected by that; sets of a group that are still in different components are
compared inside tasks, block against block, and only a forest of links leaves them, so a large group never becomes all
its pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_map, fresh, materialize, pack
from ridgeline.llm.components import components, forest
from ridgeline.llm.simhash import near_fingerprints, set_fingerprint

SEED = 42
BITS = 6  # budget of the tries
BANDS, ROWS = 40, 4
AT_ONCE = 2048
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64)
_SALT, _ODD, _MIX = _RANDOM[0, :, None], _RANDOM[1, :, None] | np.uint64(1), (_RANDOM[2] | np.uint64(1)).reshape(BANDS, ROWS)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; a shorter text is one run, a blank one has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(parts))
    starts, ends = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: equal where two sets have the same smallest hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        np.minimum(low, ((found[at : at + AT_ONCE] ^ _SALT) * _ODD).min(axis=1), out=low)
    return (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _marks(words: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    digests, prints, keys = [], [], []
    for value in batch.column(1):
        found = shingles(value.as_py(), words)
        digests.append(xxhash.xxh64_intdigest(found.tobytes()))
        prints.append(set_fingerprint(found))
        keys.append(band_keys(found) if len(found) else np.empty(0, np.int64))
    digest, mark = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (digests, prints))
    arrays = [batch.column(0), batch.column(1), digest, mark, pa.array(keys, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, ["doc", "text", "digest", "print", "bands"])


FILTER_BITS = 1 << 25  # 4 MB, whatever the number of keys: beyond some ten million it lets more rows pass


def _places(key: Column) -> list[Column]:
    """Two bits of a filter for a 64-bit hash."""
    return [key.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(key, 25).bitwiseAND(F.lit(FILTER_BITS - 1))]


class KeyFilter:
    """A bit array of fixed size that tells rows whose key is surely not among some keys.

    It only spares a shuffle: what passes is still joined exactly.
    """

    def __init__(self, keys: DataFrame):
        places = keys.select(F.explode(F.array(*_places(F.xxhash64(keys.columns[0])))).alias("place"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
        words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        found = words.toArrow()  # FILTER_BITS / 64 rows at most
        bits = np.zeros(FILTER_BITS // 64, np.int64)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.sent = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def passing(self, hashed: pa.Array) -> np.ndarray:
        """Rows whose ``xxhash64`` may be that of a key; a null is none."""
        valid = np.array(hashed.is_valid())
        key = hashed.fill_null(0).to_numpy().view(np.uint64)
        bits = self.sent.value
        for place in (key & np.uint64(FILTER_BITS - 1), key >> np.uint64(25) & np.uint64(FILTER_BITS - 1)):
            valid &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return valid


def _sets(words: int, needed: KeyFilter, batch: pa.RecordBatch) -> pa.RecordBatch:
    batch = batch.filter(pa.array(needed.passing(batch.column(2))))
    found = [shingles(value.as_py(), words).view(np.int64) for value in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["digest", "found"])


def shingle_sets(marked: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """``digest, found`` of the needed digests; the other texts stay where they are stored."""
    needed = materialize(needed.distinct(), "needed-sets")
    rows = marked.select("digest", "text", F.xxhash64("digest"))
    sets = arrow_map(rows, partial(_sets, words, KeyFilter(needed)), "digest long, found array<long>")
    return materialize(sets.dropDuplicates(["digest"]).join(needed, "digest", "left_semi"), "shingle-sets")


def _alike(sets: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """The pairs ``u, v`` of digests whose sets are as similar as ``limit`` or more."""
    both = pairs.join(sets.toDF("v", "b"), "v").join(sets.toDF("u", "a"), "u")
    both = both.select("u", "v", F.size("a").alias("x"), F.size("b").alias("y"), F.size(F.array_intersect("a", "b")).alias("same"))
    return materialize(both.where(F.col("same") / (F.col("x") + F.col("y") - F.col("same")) >= limit).select("u", "v"), "near-sets")


BLOCK_SETS, BLOCK_HASHES = 1024, 1 << 21  # sets, and hashes (16 MB), of a part of a band
TOKENS = 4096


def _block_links(limit: float, table: pa.Table) -> pa.Table:
    """Links between two parts of a band, or within one: a forest of them, never all pairs."""
    number = table.column("part").to_numpy()
    band = table.column("band")[0].as_py()
    digest, root = table.column("digest").to_numpy(), table.column("root").to_numpy()
    sets = [v.values.to_numpy() for v in table.column("found").combine_chunks()]
    size = np.array([len(v) for v in sets])
    a = np.flatnonzero(number == table.column("i")[0].as_py())
    b = a if table.column("i")[0].as_py() == table.column("j")[0].as_py() else np.flatnonzero(number == table.column("j")[0].as_py())
    apart = (root[a][:, None] != root[b]) & (np.minimum(size[a][:, None], size[b]) >= limit * np.maximum(size[a][:, None], size[b]))
    if a is b:
        apart &= digest[a][:, None] < digest[b]
    # a pair that shares several open bands is compared in the smallest of them
    smaller = [[k for k in own if k < band] for own in table.column("bands").to_pylist()]
    if apart.any():
        apart &= _common(smaller, a, b) == 0
    rows, columns = np.nonzero(apart)
    if len(rows) <= 8 * (len(a) + len(b)):
        same = np.array([len(np.intersect1d(sets[a[i]], sets[b[j]], assume_unique=True)) for i, j in zip(rows, columns)])
    else:
        same = _common(sets, a, b)[rows, columns]
    near = same >= limit * (size[a[rows]] + size[b[columns]] - same) if len(rows) else np.zeros(0, bool)
    child, parent = forest(digest[a[rows[near]]], digest[b[columns[near]]])
    return pa.table({"u": pa.array(child, pa.int64()), "v": pa.array(parent, pa.int64())})


def _common(sets: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values every set of ``a`` shares with every other set of ``b``: products of membership, some values at a time."""
    lengths = [len(v) for v in sets]
    if not sum(lengths):
        return np.zeros((len(a), len(b)), np.float32)
    _, place, times = np.unique(np.concatenate([np.asarray(v, np.int64) for v in sets]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    shared = times[place] > 1  # others cannot be common
    place, owner = np.unique(place[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, place[-1] + 1 if len(place) else 0, TOKENS):
        low, high = np.searchsorted(place, [first, first + TOKENS])
        member = np.zeros((len(sets), TOKENS), np.float32)
        member[owner[low:high], place[low:high] - first] = 1
        out += member[a] @ member[b].T
    return out


def _open_links(members: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """Links between the sets of a band that are in different components yet; ``members``: ``band, digest, root``.

    Sets travel once for each open band and part of it, and are compared in their tasks. A large band is cut into
    parts, and each two parts meet in a task of their own.
    """
    bands = members.groupBy("digest").agg(F.collect_list("band").alias("bands"))  # 40 at most
    rows = materialize(members.join(bands, "digest").join(sets, "digest"), "open-sets")
    sizes = rows.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum(F.size("found")) / BLOCK_HASHES)).cast("int").alias("parts"))
    dealt = rows.join(materialize(sizes, "open-sizes"), "band").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "digest", "root", "bands", "found")

    def work(table: pa.Table) -> pa.Table:
        return _block_links(limit, table)

    return materialize(dealt.groupBy("band", "i", "j").applyInArrow(work, "u long, v long"), "open-links")


def trie_groups(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """``digest, band, low`` of sets whose fingerprints a chain within ``bits`` connects; ``band`` names the group, ``low`` is its smallest set.

    All sets of a group are candidates of each other. Sets alone in theirs are left out.
    """
    prints = materialize(marked.select("digest", "print").distinct(), "set-prints")
    linked = materialize(components(near_fingerprints(prints.select("print").distinct(), bits)), "linked-prints")
    named = prints.join(linked, F.col("print") == F.col("node"), "left")
    named = materialize(named.select("digest", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("band")), "print-groups")
    shared = named.groupBy("band").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    return materialize(named.join(materialize(shared.select("band", "low"), "shared-groups"), "band").select("digest", "band", "low"), "group-members")


def near_sets(marked: DataFrame, words: int, limit: float) -> DataFrame:
    """Links ``u, v`` that connect all digests of ``marked`` (``digest, print, bands, text``) at ``limit`` or more."""
    grouped = trie_groups(marked)
    distinct = marked.groupBy("digest").agg(F.first("bands").alias("bands"))
    distinct = distinct.join(grouped.select("digest", F.col("band").alias("own")), "digest", "left")
    keys = materialize(distinct.select("digest", F.coalesce("own", "digest").alias("own"), F.explode("bands").alias("band")), "bands")
    # only bands with sets that the tries leave apart
    # stored, so that both sides of the join are dealt out anew and a band that very many sets share can be split
    shared = keys.groupBy("band").agg(F.min("digest").alias("low"), F.min("own").alias("one"), F.max("own").alias("other")).where("one <> other")
    shared = materialize(shared.select("band", "low"), "shared-bands")
    member = materialize(keys.drop("own").join(shared, "band").select("digest", "band", "low").unionByName(grouped), "band-members")
    pairs = materialize(member.where("digest <> low").select(F.col("low").alias("u"), F.col("digest").alias("v")).distinct(), "candidates")
    sets = shingle_sets(marked, pairs.select(F.explode(F.array("u", "v")).alias("digest")), words)
    links = _alike(sets, pairs, limit)
    roots = materialize(components(links), "near-roots")
    now = member.join(roots, F.col("digest") == F.col("node"), "left").select("band", "digest", "low", F.coalesce("root", "digest").alias("root"))
    now = materialize(now, "band-roots")
    apart = now.groupBy("band").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("band")
    # the smallest set of a band has been compared with all others
    left = materialize(now.where("digest <> low").join(materialize(apart, "open-bands"), "band", "left_semi").select("band", "digest", "root"), "open-members")
    return links.unionByName(_open_links(left, sets, limit))


def _split(names: list[str], at: int, dropped: KeyFilter, maybe: bool, batch: pa.RecordBatch) -> pa.RecordBatch:
    passing = dropped.passing(batch.column(at))
    return pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.filter(pa.array(passing == maybe)).columns) if i != at], names)


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (one column); rows without id stay.

    Rows that a filter of fixed size tells to be kept stay where they are; only the others are joined.
    """
    gone = materialize(gone.distinct(), "gone-ids")
    dropped, name = KeyFilter(gone), fresh(docs.columns, "hashed")
    # null ids have no hash
    hashed = docs.withColumn(name, F.when(F.col(f"`{id_col}`").isNotNull(), F.xxhash64(F.col(f"`{id_col}`").cast(gone.schema[0].dataType))))
    kept, maybe = (arrow_map(hashed, partial(_split, docs.columns, len(docs.columns), dropped, m), docs.schema) for m in (False, True))
    key = fresh(docs.columns, "gone")
    return kept.unionByName(maybe.join(gone.toDF(key), F.col(f"`{id_col}`") == F.col(key), "left_anti"))


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, limit: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group of near copies; rows without id stay. Columns as they were.

    Texts link if the Jaccard similarity of their sets of ``words``-word shingles is ``limit`` or more (0.8 at least,
    which the bands are made for), and groups are what a chain of links connects. Words are parted by blanks, A-Z in
    lower case; a text of fewer words is one shingle. Null, empty and blank texts are copies of each other. Rows without
    id take part by their text. An empty table gives an empty result.
    """
    if not 0.8 <= limit <= 1:
        raise ValueError("limit must be between 0.8 and 1")
    rows = pack(docs, doc=id_col, text=text_col)
    kind = rows.schema["doc"].dataType.simpleString()
    marked = materialize(arrow_map(rows, partial(_marks, words), f"doc {kind}, text string, digest long, print long, bands array<long>"), "shingled")
    roots = materialize(components(near_sets(marked, words, limit)), "near-roots")
    first = marked.groupBy("digest").agg(F.min("doc").alias("first"))
    kept = first.join(roots, F.col("digest") == F.col("node"), "left").groupBy(F.coalesce("root", "digest")).agg(F.min("first").alias("doc"))
    ids = marked.select("doc").where("doc is not null").distinct()
    return without_ids(docs, id_col, ids.join(kept.select("doc"), "doc", "left_anti"))
