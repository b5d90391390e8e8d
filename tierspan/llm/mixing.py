r"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target follows its weight, limited to `MAX_TIMES` its size. With r = target / size a document is taken floor(r)
times for certain and once more with inclusion probability r - floor(r). The cube method decides the latter: three
undecided documents at a time, their probabilities move along the null space of the two balance constraints (words and
documents), in the direction and length that a hash of the document draws, until one is 0 or 1. Each block of a source leaves two
documents undecided at most; blocks' leftovers meet in further rounds, until a landing problem of a dozen documents remains in each source, which is solved by looking
at all its outcomes. Long documents are decided first, so that what is left to land is short.

A document too long to be balanced by two others moves against all others of its block at once, along a vector that keeps both
totals, or if that leaves no room the words. It takes the way that the others can make up for. In a source of several blocks such
documents are one group, decided first; there are few, and the others share what probability they leave.

Defined results: a null text has size 0 and adds nothing; null sources are one source, after all others; rows repeated with the same
id, text and source share one decision; sources without words have target 0; reruns and other partitionings give the same
result; an empty table gives no row. The driver holds one row per source.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierspan.llm.common import SPACE, begin, materialise

WEIGHTS = (1, 2, 3)
MAX_TIMES = 3
#: Documents of a block; undecided documents that meet in a block of a later round.
BLOCK = 8192
SEED = 17
#: A document is a giant if it holds more than 1 / GIANT of a block's undecided words, counting so many blocks of a source at most.
GIANT, GIANT_BLOCKS = 64, 256
#: The landing problem: so many undecided documents of a source at most.
LANDING = 12
#: Tables of one row per source are broadcast up to so many sources.
FEW_SOURCES = 100_000
EPS = 1e-9
UNITS = "skey string, uid long, size double, p double"


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, times: int = MAX_TIMES) -> dict[str | None, float]:
    """Targets that share all sizes by weight: sources by code point, null last, weights repeating; what a limit cuts off is reshared by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > times * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = float(times * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
        left = max(left, 0.0)
    return out


def _draw(uid: int) -> float:
    """A number in [0, 1) from an id."""
    x = (uid * 0x9E3779B97F4A7C15 + SEED * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 29)) >> 11) / (1 << 53)


def _move(p: list[float], u: tuple[float, ...], draw: float) -> list[float]:
    """Move p along u or against it, as far as all stay in [0, 1]; the draw keeps the expectation."""
    ahead = min(((1 - x) / d if d > 0 else -x / d) for x, d in zip(p, u, strict=True) if d)
    back = min((x / d if d > 0 else (x - 1) / d) for x, d in zip(p, u, strict=True) if d)
    step = ahead if draw * (ahead + back) < back else -back
    moved = [x + step * d for x, d in zip(p, u, strict=True)]
    return [0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in moved]


def _take_giant(size: float, p: float, draw: float, above: float, below: float) -> float | None:
    """Whether a giant of probability p is taken (1) or not (0): the draw's way, or the other where the rest can't make up for it.

    The rest can gain `above` words and lose `below`. None where neither way can be made up for.
    """
    may_take, may_leave = (1 - p) * size <= below + EPS, p * size <= above + EPS
    if may_take and may_leave:
        return float(draw < p)
    return 1.0 if may_take else 0.0 if may_leave else None


def _made_up(x: np.ndarray, size: np.ndarray, words: float, docs: float) -> np.ndarray | None:
    """x moved so that it holds so many more words and documents: by x (1 - x) (a + b size), where a bound is met the others do the rest.

    None if a few attempts don't do; then the words alone are kept.
    """
    free, out = np.ones(len(x), bool), x.copy()
    for _ in range(12):
        h, s = (x * (1 - x))[free], size[free]
        gained = out[~free] - x[~free]
        w, d = words - (gained * size[~free]).sum(), docs - gained.sum()
        m0, m1, m2 = h.sum(), (h * s).sum(), (h * s * s).sum()
        det = m0 * m2 - m1 * m1
        if det <= 1e-9 * m0 * m2:
            return None
        out[free] = x[free] + h * ((d * m2 - w * m1) / det + (w * m0 - d * m1) / det * s)
        past = free & ((out < 0) | (out > 1))
        if not past.any():
            return out
        out = np.clip(out, 0, 1)
        free &= ~past
    return None


def _settle_giants(uid: list[int], size: list[float], p: list[float], least: int, land: bool) -> list[float]:
    """Decide documents that hold over 1 / GIANT of the undecided words, longest first, each against all others at once.

    One that the others can't make up for waits for the next round; in the last, it takes the way that leaves the lesser fault.
    """
    q, s = np.array(p), np.array(size)
    for giant in range(len(q)):
        rest = np.flatnonzero((q > 0) & (q < 1))
        rest = rest[rest > giant]
        if len(rest) < max(least, 3) or s[giant] * GIANT <= s[rest].sum() + s[giant]:
            break
        if not 0 < q[giant] < 1:
            continue
        x, words = q[rest], s[rest]
        above, below = float(((1 - x) * words).sum()), float((x * words).sum())
        taken = _take_giant(s[giant], q[giant], _draw(uid[giant] * 7), above, below)
        possible = taken is not None
        if not possible:
            if not land:
                continue
            taken = float((1 - q[giant]) * s[giant] - below < q[giant] * s[giant] - above)
        owed = (q[giant] - taken) * s[giant]
        both = _made_up(x, words, owed, q[giant] - taken) if possible else None
        if both is not None:
            x = both
        else:
            x = x + (1 - x) * min(1.0, owed / above) if owed > 0 and above > 0 else x * (1 - min(1.0, -owed / below)) if below > 0 else x
        q[giant], q[rest] = taken, np.where(x < EPS, 0.0, np.where(x > 1 - EPS, 1.0, x))
    return q.tolist()


def _settle_source(group: pa.Table) -> pa.Table:
    """The giants of one source (skey, uid, size, p, docs, words: of the whole source): those decided, so that the rest can make up for them."""
    uid, size, p, docs, words = (group.column(c).to_numpy() for c in ("uid", "size", "p", "docs", "words"))
    order = np.lexsort((uid, -size))[: max(0, int(docs[0]) - LANDING)] if len(uid) else []
    left, owed, done = (float(words[0]), float(words[0]) * float(p[0]), []) if len(uid) else (0.0, 0.0, [])
    for i in order:
        s = float(size[i])
        now = min(1.0, max(0.0, owed / left)) if left else 0.0
        taken = _take_giant(s, now, _draw(int(uid[i]) * 7), (1 - now) * (left - s), now * (left - s))
        if taken is None:  # the lesser fault: the rest is taken whole, or not at all
            taken = float(s - owed < owed - (left - s))
        done.append(taken)
        owed, left = owed - taken * s, left - s
    return pa.table([group.column("skey").take(pa.array(order, pa.int64())), pa.array(uid[order] if len(uid) else [], pa.int64()), pa.array(size[order] if len(uid) else [], pa.float64()), pa.array(done, pa.float64())], names=["skey", "uid", "size", "p"])


def flight(uid: list[int], size: list[float], p: list[float], *, land: bool) -> list[float]:
    """Inclusion probabilities after the flight over one block, longest documents first; with `land`, all of them 0 or 1.

    Each step takes the two longest undecided documents, which trade their probabilities almost one for one, and the shortest,
    which makes up the difference. So what stays undecided gets ever shorter.
    """
    out = _settle_giants(uid, size, [x if EPS < x < 1 - EPS else float(round(x)) for x in p], LANDING if land else 2, land)
    rest = deque(k for k, x in enumerate(out) if 0 < x < 1)
    while len(rest) > (LANDING if land else 2):
        held = (rest[0], rest[1], rest[-1])
        a, b, c = (size[i] for i in held)
        u = (b - c, c - a, a - b)
        top = max(map(abs, u))
        u = tuple(x / top for x in u) if top > EPS else (1.0, -1.0, 0.0)
        for i, x in zip(held, _move([out[i] for i in held], u, _draw(uid[held[0]] * 5 + uid[held[1]] * 3 + uid[held[2]])), strict=True):
            out[i] = x
        first, second = rest.popleft(), rest.popleft()
        rest.extendleft(k for k in (second, first) if 0 < out[k] < 1)
        if not 0 < out[rest[-1]] < 1:
            rest.pop()
    if land:
        _land(list(rest), size, out)
        _swap(size, p, out)
    return out


def _land(held: list[int], size: list[float], p: list[float]) -> None:
    """Decide the last few documents: of all ways to do so, the one that comes nearest to their expected words, then number."""
    ways = (np.arange(1 << len(held))[:, None] >> np.arange(len(held))) & 1
    sizes, chances = np.array([size[i] for i in held]), np.array([p[i] for i in held])
    words = np.abs(ways @ sizes - chances @ sizes)
    number = np.abs(ways.sum(1) - chances.sum())
    best = np.lexsort((np.arange(len(ways)), number, np.round(words, 6)))[0]
    for i, taken in zip(held, ways[best], strict=True):
        p[i] = float(taken)


def _swap(size: list[float], expected: list[float], p: list[float]) -> None:
    """End of the landing: where the dozen left words over, exchange the taken and the left document whose lengths differ by most nearly as many."""
    s, q, open_ = np.array(size), np.array(p), np.array([0 < x < 1 for x in expected], dtype=bool)
    for _ in range(3):
        over = float((q * s).sum() - np.dot(expected, s))
        taken, left = np.flatnonzero(open_ & (q == 1)), np.flatnonzero(open_ & (q == 0))
        if abs(over) < 1 or not len(taken) or not len(left):
            break
        left = left[np.argsort(s[left], kind="stable")]
        at = np.clip(np.searchsorted(s[left], s[taken] - over), 1, max(1, len(left) - 1))
        near = np.stack([at - 1, np.minimum(at, len(left) - 1)])
        fault = np.abs(over - s[taken] + s[left][near])
        side, i = np.unravel_index(np.argmin(fault), fault.shape)
        if fault[side, i] >= abs(over) - 1e-6:
            break
        q[taken[i]], q[left[near[side, i]]] = 0.0, 1.0
    p[:] = q.tolist()


def _decide(group: pa.Table) -> pa.Table:
    """The flight over one block; where it is a source's only one, its units land."""
    uid, size, p, n = (group.column(c).to_numpy() for c in ("uid", "size", "p", "_n"))
    order = np.lexsort((uid, -size))
    done = flight(uid[order].tolist(), size[order].tolist(), p[order].tolist(), land=bool(len(n) and n[0] == 1))
    return pa.table([group.column("skey").take(pa.array(order)), pa.array(uid[order]), pa.array(size[order]), pa.array(done, pa.float64())], names=["skey", "uid", "size", "p"])


def _words(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def _unit_id() -> Column:
    null = lambda c: F.col(c).isNull()
    return F.xxhash64("doc_id", null("doc_id"), "text", null("text"), "source", null("source"))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))


def _per_source(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """`rows` with a table of one row per source: told to all tasks, as one source may hold much of the rows."""
    return rows.join(F.broadcast(sources) if n <= FEW_SOURCES else sources, "skey")


def _giants(units: DataFrame, n: int) -> DataFrame:
    """Decided giants of each source of several blocks (a single block settles its own). Every document as long as 2**k or longer is one, for the largest k that leaves a rest in which
    2**k is at most 1 / GIANT of a block's words; so there are at most 2 * GIANT * GIANT_BLOCKS for each power of two."""
    power = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1.0)))).cast("int")
    words = units.groupBy("skey", power.alias("_k")).agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_docs"))
    whole = Window.partitionBy("skey")
    words = words.withColumns({"_rest": F.sum("_words").over(whole.orderBy("_k")), "words": F.sum("_words").over(whole), "docs": F.sum("_docs").over(whole)})
    blocks = F.least(F.lit(GIANT_BLOCKS), F.ceil(F.col("docs") / BLOCK))
    fits = F.pow(F.lit(2.0), F.col("_k") + 1) * GIANT * blocks <= F.col("_rest")
    least = words.groupBy("skey", "words", "docs").agg(F.coalesce(F.max(F.when(fits, F.pow(F.lit(2.0), F.col("_k") + 1))), F.lit(1.0)).alias("_least"))
    found = _per_source(units, least.where(F.col("docs") > BLOCK), n).where("size >= _least").select("skey", "uid", "size", "p", "docs", "words")
    return found.groupBy("skey").applyInArrow(_settle_source, UNITS)


def _flight(units: DataFrame, docs_per_source: dict[str, int]) -> DataFrame:
    """(uid, p) with p 0 or 1: rounds of flights, each over the undecided units of the one before."""
    spark = units.sparkSession
    decided: list[DataFrame] = []
    blocks = {s: -(-n // BLOCK) for s, n in docs_per_source.items()}
    while True:
        last = all(b <= 1 for b in blocks.values())
        dealt = _per_source(units, spark.createDataFrame(list(blocks.items()) or [("", 1)], "skey string, _n long"), len(blocks))
        dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("uid"), F.col("_n")))
        made = materialise(dealt.groupBy("skey", "_block").applyInArrow(_decide, UNITS), "mix-flight")
        decided.append(made.where("p = 0 OR p = 1"))
        if last:
            break
        units = made.where("p > 0 AND p < 1")
        blocks = {s: -(-2 * b // BLOCK) if b > 1 else 1 for s, b in blocks.items()}
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select("uid", "p")


def takes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and _uid, the id of its decision."""
    spark = docs.sparkSession
    begin(spark)
    rows = materialise(docs.select("doc_id", "source", _words("text").alias("size"), _unit_id().alias("_uid"), _source_key().alias("skey")), "mix-rows")
    stats = rows.groupBy("skey").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    names = {r["skey"]: r["skey"][1:] if r["skey"] else None for r in stats}
    sizes = {names[r["skey"]]: r["size"] for r in stats}
    targets = source_targets(sizes)
    per = []
    for r in stats:
        size, target = r["size"], targets[names[r["skey"]]]
        rate = target / size if size else 0.0
        whole = int(rate + EPS)
        per.append((r["skey"], size, target, whole, max(0.0, rate - whole) if rate - whole > EPS else 0.0))
    sources = spark.createDataFrame(per, "skey string, source_size long, target double, _whole long, _part double")
    units = rows.groupBy("skey", F.col("_uid").alias("uid")).agg(F.sum("size").cast("double").alias("size"))
    units = _per_source(units, sources.where("_part > 0").select("skey", F.col("_part").alias("p"), F.col("source_size").cast("double").alias("words")), len(per))
    giants = materialise(_giants(units.select("skey", "uid", "size", "p"), len(per)), "mix-giants")
    settled = giants.groupBy("skey").agg(F.sum("size").alias("_done"), F.sum(F.col("p") * F.col("size")).alias("_taken"))
    rest = units.join(giants.select("skey", "uid"), ["skey", "uid"], "left_anti")
    settled = sources.select("skey").join(settled, "skey", "left").fillna(0.0, ["_done", "_taken"])
    left = F.col("words") - F.col("_done")
    shared = F.when(left > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("p") * F.col("words") - F.col("_taken")) / left))).otherwise(F.col("p"))
    rest = _per_source(rest, settled, len(per)).select("skey", "uid", "size", shared.alias("p"))
    decided = _flight(rest, {r["skey"]: r["n"] for r in stats}).unionByName(giants.select("uid", "p"))
    out = _per_source(rows, sources, len(per)).join(decided.withColumnRenamed("uid", "_uid"), "_uid", "left")
    copies = F.col("_whole") + F.coalesce(F.col("p"), F.lit(0.0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_uid")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    taken = takes(docs).where("copies > 0").groupBy("_uid").agg(F.max("copies").alias("_copies"))
    wide = docs.select(F.struct("*").alias("_row"), _unit_id().alias("_uid")).join(taken, "_uid")
    return wide.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_k")).select("_row.*")
