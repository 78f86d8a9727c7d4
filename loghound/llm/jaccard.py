"""N-gram Jaccard join through a token-group matrix (operator 9)."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghound.llm.common import components, discard, empty_if_null, prepare, stage, table
from loghound.llm.hashing import Rolling, byte_values, mix, powers

#: Words of a shingle, and the similarity from which two sets link, in percent.
WORDS = 3
PERCENT = 90
#: Ratio of the set sizes in one band.  Parts of a set beyond the provable number: SPARE_PARTS, and for
#: sets that may differ in few tokens SPARE_SMALL divided by that number.
BAND = 1.3
SPARE_PARTS = 4
SPARE_SMALL = 24
#: Chance that a pair at the similarity limit shares no more keys than each of its sets may leave out, and
#: the number of parts up to which that chance is added up exactly, beyond it bounded.
MISS = 1e-9
EXACT_PARTS = 500
#: Passes over the keys: only the keys of one pass are in the shuffle at a time.
KEY_PASSES = 2
#: Tokens of one block of similar sets, and sets whose token union is one row of the matrix.
BLOCK_TOKENS = 800_000
GROUP_ROWS = 32
#: The same for the lower similarity of the pipeline, whose groups are larger: each block of a group is sent
#: once for every other one, so larger blocks send less; a task holds two of them (about 350 MB at its peak).
KEEP_BLOCK_TOKENS = 2_000_000
#: Further parts at that similarity (at most four for each token that may differ): more shared keys, of which
#: more may be left out; at 0.9 the parts above suffice.
KEEP_PARTS = 30
#: Bytes that are tokenised at once in a worker.
BLOCK_BYTES = 1_500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text.

    A text with fewer words than a shingle has one hash for all of them, one
    without words has none.
    """
    out: list[np.ndarray] = []
    values = byte_values()
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    at = 0
    up = down = np.zeros(0, dtype=np.uint64)
    while at < len(texts):
        block, size = [], 0
        while at < len(texts) and (not block or size + len(texts[at]) < BLOCK_BYTES):
            block.append(texts[at].translate(_LOWER))
            size += len(texts[at]) + 1
            at += 1
        data = np.frombuffer(b" ".join(block) + b" ", dtype=np.uint8)
        if len(up) <= len(data):
            up, down = powers(len(data))
        blank = space[data]
        change = np.diff(blank.astype(np.int8), prepend=1)
        starts, ends = np.nonzero(change == -1)[0], np.nonzero(change == 1)[0]
        word = Rolling(data, values, up, down).of(starts, ends)
        bounds = np.cumsum([0] + [len(b) + 1 for b in block])
        cut = np.searchsorted(starts, bounds)
        n = len(word)
        gram = word[:max(0, n - words + 1)].copy()
        for k in range(1, words):
            gram = mix(gram * np.uint64(3) + word[k:n - words + 1 + k])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(gram[a:b - words + 1]))
            elif b > a:
                h = np.array([b - a], dtype=np.uint64)
                for w in word[a:b]:
                    h = mix(h * np.uint64(5) + w)
                out.append(h)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def bands(most: int = 2 ** 31) -> list[int]:
    low = [1]
    while low[-1] < most:
        low.append(max(low[-1] + 1, int(low[-1] * BAND)))
    return low


def _hit(balls: int, bins: int, parts: int) -> np.ndarray:
    """Chances that 0, 1, ... of the first ``bins`` of ``parts`` parts get one of ``balls`` tokens at least."""
    chance = np.zeros(bins + 1)
    chance[0] = 1
    more = (bins - np.arange(bins + 1)) / parts
    for _ in range(balls):
        moved = chance * more
        chance -= moved
        chance[1:] += moved[:-1]
    return chance


def sure_keys(differ: int, common: int, parts: int) -> int:
    """Most keys m so that sets with so many tokens apart and in common share more than m, but for MISS.

    They share the key of a part that gets a common token and none in which they differ.  The number
    of parts left free is bounded below first, then the number of those that get a common token.
    For many parts the exact sums are replaced by Chernoff's bound, which holds as the parts
    are negatively associated.
    """
    if parts <= EXACT_PARTS:
        free = int(np.searchsorted(np.cumsum(_hit(differ, parts, parts)[::-1]), MISS / 2, side="right"))
        return max(0, int(np.searchsorted(np.cumsum(_hit(common, free, parts)), MISS / 2, side="right")) - 1)
    share = (1 - 1 / parts) ** differ * (1 - (1 - 1 / parts) ** common)
    low, high = 0, int(share * parts)
    while low < high:
        mid = (low + high + 1) // 2
        x = mid / parts
        if parts * (x * math.log(x / share) + (1 - x) * math.log((1 - x) / (1 - share))) >= -math.log(MISS):
            low = mid
        else:
            high = mid - 1
    return low


@lru_cache(None)
def band_parts(percent: int = PERCENT, further: int = 0) -> list[tuple[int, int]]:
    """For each band its number of parts, and how many of its shared keys a set may leave out.

    A pair that differs in d tokens has at least ``d * percent / (100 - percent)`` in common, and never
    less than that share of the smallest larger set.  The chance of a shared part first grows
    and then falls with d along that bound, so that its two ends are looked at.
    """
    low, out = bands(), []
    for least, beyond in zip(low, low[1:]):
        differ = 2 * (beyond - 1) * (100 - percent) // (100 + percent)
        if not differ:
            out.append((1, 0))
            continue
        parts = differ + 1 + SPARE_PARTS + SPARE_SMALL // differ + min(4 * differ, further)
        common = -(-percent * least // 100)
        out.append((parts, min(sure_keys(d, max(common, -(-d * percent // (100 - percent))), parts)
                               for d in (differ, min(differ, common * (100 - percent) // percent)))))
    return out


def signatures(tokens: np.ndarray, low: list[int], plan: list[tuple[int, int]], percent: int = PERCENT) -> np.ndarray:
    """Keys of which two linked sets share one.

    Sets of sizes a <= b link only if they differ in at most
    ``(a + b) * (100 - percent) / (100 + percent)`` tokens.  The hash range is
    cut into more parts than that for the largest size of a band, so that a
    linked pair agrees in whole parts; the key of a part is the hash of its
    tokens, its last bit that of the band.  A set is keyed for its own band and, where a larger partner can
    be in the next one, for that too.  Empty parts give no key; the
    spare parts keep the chance that a linked pair agrees in empty parts only
    at a few in a million for the smallest sets and far below for others.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.int64)
    j = bisect_right(low, n) - 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(tokens + np.uint64(0x51ED270B)), out=sums[1:])
    keys = []
    for band in (j, j + 1) if 100 * n >= percent * low[j + 1] else (j,):
        parts = plan[band][0]
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        full = np.nonzero(cut[1:] > cut[:-1])[0]
        value = sums[cut[full + 1]] - sums[cut[full]]
        key = mix(value ^ mix(np.uint64(band << 32) + full.astype(np.uint64)))
        keys.append(key & ~np.uint64(1) | np.uint64(band & 1))
    return np.concatenate(keys).view(np.int64)


def linked_pairs(sets: list[np.ndarray], left: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``sets``: a spanning forest, each link verified.

    The sets are ordered by their lowest hashes and cut into groups of
    GROUP_ROWS; the token-group matrix holds for every token the groups whose
    token union has it.  Adding up its rows for a query's tokens bounds the
    overlap with every member of a group; only groups that can reach the
    threshold, and hold a set not yet connected with the query, are opened.
    With ``left`` (one flag per set) only pairs of a flagged and an unflagged
    set are looked at.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = sorted(range(n), key=lambda i: (tuple(sets[i][:3].tolist()), len(sets[i])))
    sets = [sets[i] for i in order]
    sizes = sizes[order]
    side = None if left is None else np.asarray(left)[order]
    flat = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    names, ids = np.unique(flat, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    group = np.arange(n) // GROUP_ROWS
    n_groups = int(group[-1]) + 1 if n else 0
    smallest = np.minimum.reduceat(sizes, np.arange(0, n, GROUP_ROWS)) if n else sizes
    # the matrix: for each token the groups whose union has it
    cell = np.unique(ids.astype(np.int64) * n_groups + np.repeat(group, sizes))
    row_of, col = cell // max(1, n_groups), cell % max(1, n_groups)
    row_at = np.searchsorted(row_of, np.arange(len(names) + 1))

    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    mark = np.zeros(len(names), dtype=bool)
    for q in range(n):
        own = ids[first[q]:first[q + 1]]
        spans = row_at[own], row_at[own + 1]
        total = spans[1] - spans[0]
        cols = col[np.repeat(spans[0] - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum())]
        bound = np.bincount(cols, minlength=n_groups)
        need = -(-percent * np.maximum(sizes[q], smallest) // 100)
        open_ = np.nonzero((bound >= need) & (np.arange(n_groups) >= group[q]))[0]
        mark[own] = True
        for g in open_:
            a, b = max(q + 1, g * GROUP_ROWS), min(n, (g + 1) * GROUP_ROWS)
            if side is not None and a < b and not (side[a:b] != side[q]).any():
                continue
            if a >= b or len({find(i) for i in range(a, b)} | {find(q)}) == 1:
                continue
            inter = np.add.reduceat(mark[ids[first[a]:first[b]]], first[a:b] - first[a], dtype=np.int64)
            union = sizes[q] + sizes[a:b] - inter
            for i in np.nonzero(100 * inter >= percent * union)[0] + a:
                if side is not None and side[i] == side[q]:
                    continue
                x, y = find(q), find(i)
                if x != y:
                    root[y] = x
                    links.append((order[q], order[int(i)]))
        mark[own] = False
    return links


def ties(keys: list[DataFrame], drops: DataFrame) -> DataFrame:
    """Pairs (doc_id, first) whose components hold every linked pair.

    ``keys``: tables (doc_id, key), each with all rows of its keys; ``drops``:
    (doc_id, even, odd), how many keys of even and odd bands a document may leave out.
    It leaves out those that most documents have.  A linked pair shares more
    keys than that, so both keep the rarest one they share: keys are ranked
    alike for all.  So lines that many documents hold tie only those that are
    made of little else.  Each document is tied to the smallest id that keeps
    the same key, never to all others.
    """
    hits = []
    for some in keys:
        # written, so that the first shuffle of the keys is gone before the second
        shared = stage(some.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
        # both sides grow with the input: one plan at every size
        hits.append(stage(some.join(shared.hint("merge"), "key").select("doc_id", "key", "rows")))
        discard(shared)
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    drop = drops.groupBy("doc_id").agg(F.min("even").alias("even"), F.min("odd").alias("odd"))
    is_odd = F.col("key").bitwiseAND(F.lit(1).cast("long"))
    commonest = Window.partitionBy("doc_id", "side").orderBy(F.desc("rows"), "key")
    kept = stage(found.withColumn("side", is_odd).join(drop, "doc_id").withColumn("rank", F.row_number().over(commonest))
                 .where(F.col("rank") > F.when(F.col("side") == 1, F.col("odd")).otherwise(F.col("even")))
                 .select("doc_id", "key"))
    discard(*hits)
    first = kept.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    out = stage(kept.join(first.hint("merge"), "key").where("doc_id <> first").select("doc_id", "first").distinct())
    discard(kept)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                    block_tokens: int = BLOCK_TOKENS, further: int = 0) -> DataFrame:
    """Connected components of documents whose shingle sets are similar.

    1. One pass over the texts keeps the set size, a hash of the set and its
       part signatures.  Equal sets are one class.
    2. Documents that share a signature may link; see :func:`ties`.  The
       components of these ties partition the documents into groups of similar
       ones that no link leaves.
    3. For groups with several classes the texts of one document per class
       are read again.  A group beyond ``block_tokens`` tokens is cut by set
       size, each part is dealt to blocks of about ``block_tokens``; every
       pair of blocks of a part is one task that runs the token-group matrix
       and returns verified links.
    4. Components of the verified links.

    Cases: a text that is null or has no words has an empty set and is alone;
    rows with equal doc_id count as one document; a null doc_id keeps a null
    component and links with nothing; an empty table gives no rows; other
    columns are not read.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable).
    """
    low, plan = bands(), band_parts(percent, further)

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets([t.encode() for t in pdf["text"]], words)
            whole = [int(np.bitwise_xor.reduce(mix(s * np.uint64(7)), initial=np.uint64(0))) - 2 ** 63 for s in sets]
            total = [int(mix(s).sum(dtype=np.uint64)) - 2 ** 63 for s in sets]
            own = [bisect_right(low, max(1, len(s))) - 1 for s in sets]
            keys = [signatures(s, low, plan, percent) for s in sets]
            turn = [(k >> 1) % KEY_PASSES for k in keys]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(s) for s in sets], "h1": whole, "h2": total,
                                "even": [plan[j + j % 2][1] for j in own], "odd": [plan[j + 1 - j % 2][1] for j in own],
                                **{f"keys{p}": [k[t == p] for k, t in zip(keys, turn)] for p in range(KEY_PASSES)}})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_if_null(F.col("text")).alias("text"))
    names = [f"keys{p}" for p in range(KEY_PASSES)]
    a = stage(d.mapInPandas(sets_of, "doc_id long, n long, h1 long, h2 long, even int, odd int, "
                            + ", ".join(f"{k} array<long>" for k in names)))
    slim = stage(a.drop(*names))
    keyed = a.where("doc_id is not null")
    tied = ties([keyed.select("doc_id", F.explode(k).alias("key")) for k in names],
                slim.where("doc_id is not null").select("doc_id", "even", "odd"))
    discard(a)
    roots = components(tied, "doc_id", "first")

    slim = slim.select("doc_id", "n", "h1", "h2")
    members = stage(roots.join(slim.where("doc_id is not null"), roots["node"] == slim["doc_id"])
                    .select("doc_id", "root", "n", "h1", "h2"))
    classes = members.groupBy("root", "n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    # a document id that stands in several rows ties its classes together
    classes = stage(classes)

    def large(by: list[str], rows: DataFrame) -> DataFrame:
        return (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("tokens"))
                .where("classes > 1").withColumn("blocks", F.ceil(F.col("tokens") / block_tokens)).drop("classes", "tokens"))

    # a group beyond one block is cut by set size: the smaller of two linked sets also stands with the next
    # doubling if a partner can be there, so no link is lost
    home = F.floor(F.log2("n"))
    reach = F.floor(F.log2(F.col("n") * 100 / percent) + 1e-9)
    grouped = stage(classes.join(large(["root"], classes), "root")
                    .withColumn("part", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(-1).cast("long")))
                                                  .otherwise(F.array_distinct(F.array(home, reach)))))
                    .select(F.col("rep").alias("doc_id"), "root", "part", "n"))
    wanted = (grouped.join(large(["root", "part"], grouped), ["root", "part"])
              .select("doc_id", "root", "part", "blocks").distinct())

    # the texts themselves are dealt: compressed they are well below the eight bytes of a token
    dealt = (d.join(wanted.hint("merge"), "doc_id")
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("root", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "doc_id", "text"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id"], kind="stable")
        ids = pdf["doc_id"].to_numpy()
        sets = shingle_sets([t.encode() for t in pdf["text"]], words)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        links = linked_pairs(sets, None if i == j else (pdf["block"] == i).to_numpy(), percent)
        return pd.DataFrame({"a": [ids[x] for x, _ in links], "b": [ids[y] for _, y in links]}).astype("int64")

    links = dealt.groupBy("root", "part", "i", "j").applyInPandas(verify, "a long, b long")
    # equal sets link by themselves; an id with several texts ties their classes
    equal = members.join(classes, ["root", "n", "h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.union(equal.where("a <> b")))
    return (slim.join(final, slim["doc_id"] == final["node"], "left")
            .select(slim["doc_id"], F.col("n").alias("n_shingles"),
                    F.coalesce("root", slim["doc_id"]).alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    All columns stay.  Rows without doc_id stay.  Rows that share a doc_id
    and a text are one document; texts that share a doc_id only are told apart
    by a hash of both in place of the id, so an unlike text is never lost.
    """
    own = F.col("doc_id").cast("long")
    text = empty_if_null(F.col("text"))
    keyed = docs.where(own.isNotNull())
    odd = stage(keyed.select(own.alias("_id"), F.xxhash64(text).alias("_h")).groupBy("_id")
                .agg(F.min("_h").alias("_low"), F.max("_h").alias("_high")).where("_low <> _high").select("_id"))
    if odd.isEmpty():
        named = keyed.withColumn("_key", own)
    else:
        named = (keyed.join(odd, own == F.col("_id"), "left")
                 .withColumn("_key", F.when(F.col("_id").isNull(), own).otherwise(F.xxhash64(own, text))).drop("_id"))
    groups = near_duplicates(named.select(F.col("_key").alias("doc_id"), "text"), words, percent, KEEP_BLOCK_TOKENS, KEEP_PARTS).where(
        "doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    kept = named.join(groups, F.col("_key") == F.col("_kept")).dropDuplicates(["_key"]).select(*docs.columns)
    return kept.unionByName(docs.where(own.isNull())).select(*docs.columns)


def op9_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
