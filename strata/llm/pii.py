"""Personal data by patterns and by bootstrapped contexts, with DataFrame functions only.

Base entities (email, ip, card, phone) are seeds, and so are runs of 32 letters
and digits or more that mix both, as keys and digests do. These are no results
by themselves. The words left of seeds are patterns; patterns and the instances beside them score each other in rounds,
and identifiers beside patterns of high confidence are found as `context`.
A pattern's confidence falls with each ordinary word that follows it anywhere
in the texts; repeats of one instance beside it count once.
Offsets are code points. A null text is empty and has no entities; repeated
rows are judged alone, their instances counting once in the graph; an empty
table gives an empty result. Other columns may have any names.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import stored

# Kinds in the order of results, as patterns that find the maximal
# match without backtracking. An email's name is tried once a run of its characters,
# at the run's start or where the match before ended.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A run of eight characters or more with three digits, and one that looks made by a machine: a seed beside the base.
CANDIDATE = r"(?<![A-Za-z0-9-])(?=[A-Za-z0-9])(?=(?:[A-Za-z-]*+[0-9]){3})[A-Za-z0-9-]{8,}+"
KEY = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]{32,}$"
#: Marks between words; a + before a digit begins a phone.
MARKS = r"(?:(?!\+[0-9])[^\s\p{L}\p{N}])++"
# A word with the space and marks up to a next word, and the part of a word before a mark inside it.
BEFORE = rf"(?<!\S)(?=(\S++(?:\s++{MARKS})?+\s*+)(?=[\p{{L}}\p{{N}}+]))\S++"
INSIDE = r"(?<![A-Za-z0-9\s])(?=[\p{L}\p{N}+])(?<=((?<!\S)\S{1,39}|\S{40}))"
#: Rounds of scoring, confidence asked of a pattern and of an instance, and confident instances asked of a pattern.
ROUNDS, SURE, MIN_SEEDS, LEFT = 3, 0.6, 3, 40
#: Most found spans that are broadcast to their texts (about 100 bytes each); more are joined by a shuffle.
BROADCAST_SPANS = 300_000


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m):
    d = F.reverse(_digits(m))

    def add(total, i):
        x = F.substring(d, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "context": lambda m: F.lit(True),
}


MATCHES = "array<struct<kind:string,start:int,end:int,what:string,left:string>>"
PIECES = f"array<struct<lo:int,hi:int,found:{MATCHES}>>"


def _let(value, f):
    """f of value, which is computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _pieces(xs):
    """xs, not empty, in pieces of about the square root of its size: no array or text grows long by appending."""
    n = F.ceil(F.sqrt(F.size(xs))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda i: F.slice(xs, i * n + 1, n))


def _matches(text, kind: str, pattern: str):
    """Valid matches (kind, start, end, what, left: the text before) in order, in pieces with their range."""
    what, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def state(at, before, out, of):
        return F.struct(at.alias("at"), before.alias("before"), out.cast(of).alias("out"))

    def step(s, x):
        a = s["at"] + F.length(x["gap"])
        left = F.right(F.concat(s["before"], x["gap"]), F.lit(LEFT))
        one = F.struct(F.lit(kind).alias("kind"), a.alias("start"), (a + F.length(x["what"])).alias("end"), x["what"].alias("what"), left.alias("left"))
        return state(a + F.length(x["what"]), F.right(F.concat(left, x["what"]), F.lit(LEFT)), F.concat(s["out"], F.array(one)), MATCHES)

    def piece(s, xs):
        def joined(r):
            one = F.struct(s["at"].alias("lo"), r["at"].alias("hi"), F.filter(r["out"], lambda x: VALID[kind](x["what"])).alias("found"))
            return state(r["at"], r["before"], F.concat(s["out"], F.array(one)), PIECES)

        return _let(F.aggregate(xs, state(s["at"], s["before"], F.array(), MATCHES), step), joined)

    def found(w):
        pair = F.arrays_zip(w.alias("what"), F.slice(gaps, F.lit(1), F.size(w)).alias("gap"))
        begin = state(F.lit(0), F.lit(""), F.array(), PIECES)
        return F.when(F.size(w) > 0, F.aggregate(_let(pair, _pieces), begin, piece, lambda s: s["out"]))

    return F.coalesce(_let(what, found), F.array().cast(PIECES))


def _found(pieces):
    return F.flatten(F.transform(pieces, lambda p: p["found"]))


def _clear(more, base):
    """The matches of more that overlap none of base; pieces out of reach are passed over whole."""
    def beside(m):
        near = lambda x, lo, hi: (x[lo] < m["end"]) & (m["start"] < x[hi])
        return F.exists(base, lambda p: near(p, "lo", "hi") & F.exists(p["found"], lambda b: near(b, "start", "end")))

    return F.filter(_found(more), lambda m: ~beside(m))


def _pattern(left):
    """The last word before an instance, with the marks between."""
    return F.lower(F.regexp_extract(left, rf"(?:^|\s)(\S+(?:\s+{MARKS})?\s*)$", 1))


def _followed(own: DataFrame) -> DataFrame:
    """How often each pattern stands before any word of the texts, ordinary ones included."""
    text = F.coalesce("d.text", F.lit(""))
    left = own.select(F.explode(F.concat(F.regexp_extract_all(text, F.lit(BEFORE), F.lit(1)), F.regexp_extract_all(text, F.lit(INSIDE), F.lit(1)))).alias("left"))
    pattern = F.when(F.length("left") <= LEFT, F.lower("left")).otherwise(_pattern(F.right("left", F.lit(LEFT))))
    return left.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("words"))


def _graph(own: DataFrame) -> DataFrame:
    """Patterns of high confidence by mutual scoring of patterns and instances."""
    side = lambda c, seed: own.select(F.explode(c).alias("x")).select(_pattern(F.col("x.left")).alias("pattern"), F.xxhash64("x.what").alias("instance"), seed.cast("double").alias("seed"))
    edges = side("base", F.lit(1)).union(side("more", F.rlike("x.what", F.lit(KEY)))).filter("trim(pattern) <> ''").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = stored(edges)
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("own"), F.sum("n").alias("n")).join(_followed(own), "pattern", "left")
    others = F.greatest(F.coalesce("words", F.lit(0)) - F.col("n"), F.lit(0))
    sizes = stored(sizes.select("pattern", (F.col("own") + others).alias("size")))
    edges, scored = edges.drop("n"), edges.withColumn("sure", F.col("seed"))

    def judged(scored):
        able = scored.groupBy("pattern").agg(F.sum("sure").alias("s"), F.count_if(F.col("sure") >= SURE).alias("k")).filter(F.col("k") >= MIN_SEEDS)
        return able.join(sizes, "pattern").select("pattern", (F.col("s") / (F.col("size") + 1)).alias("p"))

    for _ in range(ROUNDS):
        # A seed is sure of itself; an instance beside no pattern with support has no confidence yet.
        instances = edges.join(judged(scored), "pattern", "left").groupBy("instance").agg(F.max(F.greatest("seed", F.coalesce("p", F.lit(0.0)))).alias("sure"))
        scored = stored(edges.join(instances, "instance"))
    return judged(scored).filter(F.col("p") >= SURE).select("pattern")


def find(docs: DataFrame, kept: list[str]) -> DataFrame:
    """d (the kept columns of docs), base and spans: arrays of kind, start, end in the order of results."""
    text = F.coalesce(F.col("d.text"), F.lit(""))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row"))
    own = row.select("row", "d", F.concat(*[_matches(text, k, p) for k, p in KINDS.items()]).alias("base"), _matches(text, "context", CANDIDATE).alias("more"))
    # Stored first: what follows would otherwise repeat the matching.
    own = stored(own).withColumn("more", _clear(F.col("more"), F.col("base"))).withColumn("base", _found(F.col("base")))
    sure = _graph(own)
    new = own.select("row", F.explode("more").alias("x")).withColumn("pattern", _pattern(F.col("x.left"))).join(sure, "pattern", "left_semi")
    new = stored(new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("x.start", "x.end"))).alias("new")))
    if new.agg(F.coalesce(F.sum(F.size("new")), F.lit(0)).alias("n")).first().n <= BROADCAST_SPANS:
        new = F.broadcast(new)  # the texts need not move
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    found = F.coalesce("new", F.array().cast("array<struct<start:int,end:int>>"))
    extra = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("context").alias("kind")))
    own = own.select("row", F.struct(*[F.col("d").getField(c).alias(c) for c in kept]).alias("d"), plain("base").alias("base"))
    return own.join(new, "row", "left").select("d", "base", F.concat("base", extra).alias("spans"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii(docs: DataFrame) -> DataFrame:
    own = find(docs.select("doc_id", "text"), ["doc_id"])
    n = [F.size(F.filter("base", (lambda k: lambda x: x["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return own.select("d.doc_id", *n, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span in text replaced by its kind in brackets."""
    text = F.col("d.text")
    last = lambda xs: F.array_max(F.transform(xs, lambda x: x["end"]))

    def step(own, at):
        def one(s, x):
            gap = F.when(x["start"] >= s["at"], F.concat(F.substring(own, s["at"] - at + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit(""))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

        return one

    def piece(s, xs):
        """Replaces the spans of one piece in the part of the text that ends with them."""
        def joined(r):
            return F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out"))

        part = F.substring(text, s["at"] + 1, F.greatest(last(xs) - s["at"], F.lit(0)))
        begin = F.struct(s["at"].alias("at"), F.lit("").alias("out"))
        return _let(_let(part, lambda own: F.aggregate(xs, begin, step(own, s["at"]))), joined)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(_let(F.sort_array("spans"), _pieces), begin, piece, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return find(docs, docs.columns).select(*[(F.when(F.size("spans") > 0, clean).otherwise(text) if c == "text" else F.col("d").getField(c)).alias(c) for c in docs.columns])
