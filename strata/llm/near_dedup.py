"""Near-duplicate groups: universal hash minima, bands, signature check, exact check, star contraction.

Rows without text or words have no shingles and stand alone. Rows with one and
the same shingle set are one class, held by its smallest doc_id; only classes
are compared. Repeated rows fall into one class. A null doc_id joins the class
of its text and is never kept. Texts of any length are taken whole; other
columns are ignored; an empty table gives an empty result.

Bands miss a link at the threshold with probability (1 - t^rows)^bands; there
are as many bands as bring it below MISSED: 44 at 0.85, 76 at 0.8. Pairs of a
bucket are settled in two linear steps:

1. Each class meets the bucket's pivot, its member with the most company in all
   buckets (of near copies of one text, nearly always that text itself).
2. Buckets whose other members still lie in several components are settled by
   what sets each class x apart from the pivot p, D(x) = x xor p. Linked classes
   x, y have |x xor y| <= c (|x| + |y|), c = (1 - t) / (1 + t), and x xor y is
   D(x) xor D(y), so D(x) and D(y) must share a least number of shingles: for x
   and y both unlinked to p at least (|D(x)| + c (|p| - |x|)) / 2; for x unlinked
   and y linked to p at least (|D(x)| - c (|x| + |p|)) / (1 + c) and at least
   |D(y)| (1 - c) / 2. Hence their rarest |D| - least + 1 shingles meet, and only
   classes with such a shingle in common are compared, if what follows it in both
   can still reach the least number. No link is lost.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.shared import HOT, attach, discard, narrow
from strata.llm.shared import stored_wide as stored
from strata.llm.tokens import portions, release

#: Hashes in a band, and the greatest probability of missing a link at the threshold.
ROWS, MISSED = 8, 1e-6
#: Ids of compared classes are broadcast up to this many; beyond it the join shuffles.
MAX_BROADCAST_IDS = 500_000
#: Texts are hashed together up to about this many shingles.
CHUNK = 16_384
SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, n: int):
        import numpy as np

        rng = np.random.default_rng(11)
        odd = lambda size: rng.integers(1, 2**63, size, dtype="u8") * np.uint64(2) + np.uint64(1)
        self.n, self.weights, self.byte = n, odd(n), odd(256)
        self.power = np.cumprod(np.full(64, odd(1)[0], "u8"))

    def __call__(self, text):
        import numpy as np

        b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower() if text else b"", "u1")
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, "u8")
        size = end - start
        if size.max() >= len(self.power):
            self.power = np.cumprod(np.full(int(size.max()) + 1, self.power[0], "u8"))
        body = self.byte[b[~space]]
        first = np.cumsum(size) - size
        body *= self.power[np.arange(len(body)) - np.repeat(first, size)]
        x = np.add.reduceat(body, first) + size.astype("u8")
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        k = min(self.n, len(x))
        mixed = np.zeros(len(x) - k + 1, "u8")
        for i in range(k):
            mixed += x[i : len(x) - k + 1 + i] * self.weights[i]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def bands_for(least: float, rows: int = ROWS) -> int:
    """The fewest bands that miss a pair of this similarity with a probability of at most MISSED."""
    import math

    return 1 if least >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(least**rows)))


def sign(docs: DataFrame, n: int, bands: int, rows: int = ROWS) -> DataFrame:
    """Shingle sets' sizes, digests, band keys and signatures (one byte of each minimum)."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        release()
        shingle, rng = Shingler(n), np.random.default_rng(5)
        a = rng.integers(0, 2**31, bands * rows, dtype="u4") * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 2**32, bands * rows, dtype="u4")
        fold = rng.integers(1, 2**63, (bands, rows), dtype="u8") * np.uint64(2) + np.uint64(1)
        salt = rng.integers(0, 2**63, bands, dtype="u8")

        def chunk(ids, sets):
            full = [i for i, s in enumerate(sets) if len(s)]
            sigs = np.zeros((len(sets), bands * rows), "u4")
            if full:
                x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype("u4")
                at = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
                h = np.empty_like(x)
                for j in range(bands * rows):
                    np.multiply(x, a[j], out=h)
                    h += b[j]
                    sigs[full, j] = np.minimum.reduceat(h, at)
            keys = ((sigs.reshape(len(sets), bands, rows).astype("u8") * fold).sum(axis=2, dtype="u8") ^ salt) * np.uint64(0x9E3779B97F4A7C15)
            low = ((sigs >> np.uint32(4)) & np.uint32(255)).astype("u1")
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.view("i8").ravel())),
                pa.array([s.tobytes() for s in low], pa.binary()),
            ], names=["doc_id", "n_shingles", "digest", "bands", "sig"])

        for batch in batches:
            for part in portions(batch):
                ids, sets, held = [], [], 0
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids.append(i)
                    sets.append(shingle(t))
                    held += len(sets[-1])
                    if held > CHUNK:
                        yield chunk(ids, sets)
                        ids, sets, held = [], [], 0
                if ids:
                    yield chunk(ids, sets)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reached) of edges a, b, by alternating large-star and small-star."""

    def large(e, total):
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        return attach(both.filter("b > a"), low, ["a"], 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e, total):
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = attach(down, low, ["a"], total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(low.select("a", F.col("m").alias("b"))).filter("a > b")

    now, mark = stored(edges.select("a", "b").filter("a != b").distinct()), None
    total = now.count()
    while True:
        wide = stored(large(now, total).filter("a != b").distinct())
        discard(now)
        now = stored(small(wide, total).distinct())
        discard(wide)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        # A fixed point of stars has one edge a node; any other state moves again.
        if state == mark and state[0] == state[2]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        mark, total = state, state[0]


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """cid, s: the full shingle sets of these classes."""
    ids = stored(ids.join(classes.select("cid", F.col("rep").alias("doc_id"), "digest"), "cid"))
    known = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids

    def run(batches):
        import hashlib

        import pyarrow as pa

        shingle = Shingler(n)
        for batch in batches:
            for part in portions(batch):
                own = [shingle(t).tobytes() for t in part.column("text").to_pylist()]
                # Rows of one doc_id may differ in text: only the class's own counts.
                same = [hashlib.md5(s).digest() == d for s, d in zip(own, part.column("digest").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(own, pa.binary())], names=["cid", "s"]).filter(pa.array(same, pa.bool_()))

    own = docs.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id").select("cid", "digest", "text")
    return own.mapInArrow(run, "cid long, s binary").dropDuplicates(["cid"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b with their sets sa, sb. An a with very many b is salted."""
    most = max(1000, pairs.count() // HOT)
    many = pairs.groupBy("a").agg((F.count("*") / most).cast("int").alias("salts")).filter("salts > 0")  # at most HOT rows
    one = sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")).join(F.broadcast(many), "a", "left")
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(0))))).select("a", "salt", "sa")
    salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts") + 1).cast("int"), F.lit(0))
    salted = pairs.join(F.broadcast(many), "a", "left").select("a", "b", salt.alias("salt"))
    return salted.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b").join(one, ["a", "salt"])


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b whose full shingle sets are alike enough."""

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets).select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _promising(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose sizes and signatures allow the similarity."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = [np.mean(np.frombuffer(x.as_buffer(), "u1") == np.frombuffer(y.as_buffer(), "u1")) >= least - 0.2 for x, y in zip(batch.column("ga"), batch.column("gb"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held, total = pairs.groupBy("a").agg(F.count("*").alias("n")), pairs.count()
    one = lambda k: classes.select(F.col("cid").alias(k), F.col("sig").alias("g" + k), F.col("n_shingles").alias("n" + k))
    both = attach(pairs.join(one("b"), "b"), one("a").join(held, "a"), ["a"], total)
    return both.filter(F.least("na", "nb") >= least * F.greatest("na", "nb")).select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _beside(pairs: DataFrame, sets: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b of different components beside one pivot that share a rare difference from it; pairs holds pivot a, class b."""

    def differ(batches):
        import numpy as np
        import pyarrow as pa

        names = ["p", "c", "token", "d", "nc", "np", "linked"]
        kinds = [pa.int64()] * 6 + [pa.bool_()]
        for batch in batches:
            for p, c, x, y in zip(*map(batch.column, ("a", "b", "sa", "sb"))):
                x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                d = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(d)) // 2
                row = (p.as_py(), c.as_py(), None, len(d), len(y), len(x), den * both >= num * (both + len(d)))
                cols = [pa.array(d.view("i8")) if v is None else pa.repeat(pa.scalar(v, t), len(d)) for v, t in zip(row, kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "p long, c long, token long, d long, nc long, np long, linked boolean"
    apart = _with_sets(pairs, sets).select("a", "b", "sa", "sb").mapInArrow(differ, schema)
    often = F.count("*").over(Window.partitionBy("p", "token"))
    ranked = apart.withColumn("f", often).withColumn("r", F.row_number().over(Window.partitionBy("p", "c").orderBy("f", "token")))
    c1, c2, d = den - num, den + num, F.col("d")
    prefix = lambda least: d - F.greatest(F.lit(1), F.ceil(least)) + 1
    rare = ranked.filter("f > 1").select("p", "c", "token", "r", "linked", "d", "nc",
        prefix((d * c2 + (F.col("np") - F.col("nc")) * c1) / (2 * c2)).alias("among"),
        prefix((d * c2 - (F.col("np") + F.col("nc")) * c1) / (2 * den)).alias("out"),
        prefix(d * num / c2).alias("in"),
    ).filter("r <= if(linked, in, greatest(among, out))")
    rare = stored(rare.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c")))
    x, y = rare.filter("not linked").alias("x"), rare.alias("y")
    # What can still meet from the first common shingle on must reach what these two classes need, and so must their sizes.
    rest = F.least(F.col("x.d") - F.col("x.r"), F.col("y.d") - F.col("y.r")) + 1
    need = ((F.col("x.d") + F.col("y.d")) * c2 - (F.col("x.nc") + F.col("y.nc")) * c1) / (2 * c2)
    able = (rest >= need) & (F.least("x.nc", "y.nc") * den >= F.greatest("x.nc", "y.nc") * num)
    same = (F.col("x.p") == F.col("y.p")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & able
    outer = x.filter("r <= among").join(y.filter("not linked and r <= among"), same & (F.col("x.c") < F.col("y.c")))
    inner = x.filter("r <= out").join(y.filter("linked"), same)
    found = outer.select("x.c", F.col("y.c").alias("o")).union(inner.select("x.c", F.col("y.c").alias("o")))
    return found.select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).distinct()


def near_dedup(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; linked where den * common >= num * all shingles."""
    least = num / den
    narrow(docs.sparkSession)
    signed = stored(sign(docs, n, bands_for(least)))
    named = signed.filter("digest is not null and doc_id is not null")
    rep = stored(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    ids = stored(signed.select("doc_id", "n_shingles", "digest"))
    total = ids.count()
    classes = named.join(rep.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    classes = stored(classes.withColumnRenamed("doc_id", "rep").withColumn("cid", F.monotonically_increasing_id()))
    discard(signed)
    member = classes.select("cid", F.explode("bands").alias("key"))
    size = member.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    many = stored(attach(member, size, ["key"], total * bands_for(least)))
    company = many.groupBy("cid").agg(F.sum("size").alias("company"))
    pivot = many.join(company, "cid").groupBy("key").agg(F.max(F.struct("company", (-F.col("cid")).alias("cid"))).alias("x"), F.count("*").alias("n"))
    buckets = attach(many, pivot.select("key", (-F.col("x.cid")).alias("a"), "n"), ["key"], many.count())
    buckets = stored(buckets.select("key", "a", F.col("cid").alias("b")).filter("a != b"))
    discard(many)
    star = stored(buckets.select("a", "b").distinct())
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    likely = stored(_promising(star, classes, least))
    sets = stored(_sets(docs, classes, ends(likely), n))
    links = stored(_confirm(likely, sets, num, den))
    discard(sets)
    comp = components(links)
    # Buckets whose classes beside the pivot lie in several components.
    placed = buckets.join(comp, buckets.b == comp.node, "left").withColumn("comp", F.coalesce("comp", "b"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("a").alias("a")).filter("lo < hi")
    open_ = stored(star.join(split.select("a").distinct(), "a", "left_semi"))
    discard(buckets)
    discard(star)
    sets = stored(_sets(docs, classes, ends(open_), n))
    beside = stored(_beside(open_, sets, comp, num, den))
    more = stored(_confirm(stored(_promising(beside, classes, least)), sets, num, den))
    discard(sets)
    discard(beside)
    if more.limit(1).count():
        comp = components(links.union(more))
    # A component has the smallest doc_id of its classes.
    own = classes.select("digest", "rep", "cid").join(comp, classes.cid == comp.node, "left").select("digest", "rep", F.coalesce("comp", "cid").alias("comp"))
    own = stored(own)
    discard(classes)
    low = own.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    final = attach(own, low, ["comp"], total).select("digest", "component_id").join(rep.select("digest", "n"), "digest")
    out = attach(ids, final, ["digest"], total, "left")
    least_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", least_id.alias("component_id"), F.coalesce(F.col("doc_id") == least_id, F.lit(False)).alias("kept"))
