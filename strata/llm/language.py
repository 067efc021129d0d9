"""Language of texts by a linear-chain conditional random field over words.

Emissions are sums of hashed affix, n-gram and lexicon (whole word) weights,
transitions are learned; forward-backward gives each word's label in runs of
SPAN words, and a text takes the label of the largest mean, the first by name
of equal ones. A word begins with letters and holds one Unicode letter at least.
Null texts and texts without letters are `und`, score 0. With nothing to learn
from, all texts are `und`. Repeated rows are judged alone, null doc_ids like any
other; columns may have any names; an empty table gives an empty result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strata.llm.shared import narrow
from strata.llm.tokens import portions, release

#: Size of the feature table, words in a run, passes over the training sample.
SLOTS, SPAN, EPOCHS = 1 << 18, 64, 2
#: The training sample: whole texts, at most this many and this many characters together, one of each label at least.
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 1200, 6_000_000
#: Words whose emissions a task keeps between batches, and bytes of text judged together.
MAX_KNOWN_WORDS, PORTION = 200_000, 1 << 20
WORD = r"[^\W\d_]+"


def slots(words: list[str]):
    """Feature slots of words: positions x 2 of n-grams, where each word begins there, and words x 7 of affixes and the word.

    A missing feature has slot SLOTS, whose weight stays zero.
    """
    import numpy as np

    c = np.frombuffer("".join(f"<{w.lower()}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    size = np.array([len(w.lower()) + 2 for w in words])
    end = np.cumsum(size)
    start = end - size
    left = np.repeat(end, size) - np.arange(len(c))

    def mixed(x, kind):
        x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(40)).astype("i8") & (SLOTS - 1)

    shift = lambda n: np.concatenate([c[n:], np.zeros(n, "u8")])
    two = c * np.uint64(1 << 21) + shift(1)
    three = two * np.uint64(1 << 21) + shift(2)
    grams = np.stack([np.where(left >= n, mixed(h, k), SLOTS) for n, h, k in ((2, two, 1), (3, three, 2))], 1)
    own = [np.where(size - 2 >= n, mixed(h[at], k), SLOTS) for n, h, at, k in (
        (1, c, start + 1, 3), (2, two, start + 1, 4), (3, three, start + 1, 5),
        (1, c, end - 2, 6), (2, two, end - 3, 7), (3, three, np.maximum(end - 4, 0), 8),
    )]
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15 | 1, "u8"))
    whole = np.add.reduceat(c * power[np.arange(len(c)) - np.repeat(start, size)], start)
    return grams, start, np.stack([*own, mixed(whole ^ (whole >> np.uint64(31)), 9)], 1)


def emissions(words: list[str], weights):
    """words x labels; weights has a zero row at SLOTS."""
    import numpy as np

    grams, start, own = slots(words)
    return np.add.reduceat(weights[grams[:, 0]] + weights[grams[:, 1]], start) + weights[own].sum(axis=1)


def marginals(emit, trans, lengths):
    """Word label probabilities, expected transitions; runs x SPAN x labels, padded."""
    import numpy as np

    n, t, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    live = np.arange(t) < np.asarray(lengths)[:, None]
    a, b, m = np.empty_like(e), np.ones_like(e), np.exp(trans)
    for i in range(t):
        a[:, i] = e[:, i] if i == 0 else (a[:, i - 1] @ m) * e[:, i]
        a[:, i] /= a[:, i].sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        step = (b[:, i + 1] * e[:, i + 1]) @ m.T
        step /= step.sum(axis=1, keepdims=True)
        b[:, i] = np.where(live[:, i + 1, None], step, 1.0)
    p = a * b
    p /= p.sum(axis=2, keepdims=True)
    return p, a, b, e, live


def letters(word: str) -> bool:
    """Digits and numerals of other scripts alone are no word."""
    return word.isalpha() or any(map(str.isalpha, word))


def runs_of(sizes):
    """First word and length of each run of SPAN words, and its text."""
    import numpy as np

    n = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(sizes) - sizes)[owner] + nth * SPAN
    return first, np.minimum(SPAN, sizes[owner] - nth * SPAN), owner


def fit(rows: list[tuple[str, str]]):
    """labels, weights (with a zero row at SLOTS), transitions from (text, label) rows."""
    import re

    import numpy as np

    labels = sorted({y for _, y in rows})
    k, place, at, sizes = len(labels), {}, [], []
    for text, _ in rows:
        words = [w for w in re.findall(WORD, text) if letters(w)]
        at += [place.setdefault(w, len(place)) for w in words]
        sizes.append(len(words))
    weights, trans = np.zeros((SLOTS + 1, k), "f4"), np.zeros((k, k), "f4")
    if not at:
        return labels, weights, trans
    grams, start, own = slots(list(place))
    at, y = np.array(at), np.array([labels.index(y) for _, y in rows])
    first, lengths, owner = runs_of(np.array(sizes))
    # Each distinct word's features in one row of a flat list.
    count = np.diff(np.append(start, len(grams))) * 2
    flat = [np.concatenate([g.ravel(), o]) for g, o in zip(np.split(grams, start[1:]), own)]
    width = count + own.shape[1]
    flat, begin = np.concatenate(flat), np.cumsum(width) - width
    grad2, order = np.full((SLOTS + 1, k), 1e-6, "f4"), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(len(first)), max(1, len(first) // 64)):
            live = np.arange(SPAN) < lengths[part][:, None]
            word = at[np.minimum(first[part][:, None] + np.arange(SPAN), len(at) - 1)]
            seen, back = np.unique(word[live], return_inverse=True)
            which = np.repeat(np.arange(len(seen)), width[seen])
            slot = flat[np.arange(len(which)) - np.repeat(np.cumsum(width[seen]) - width[seen] - begin[seen], width[seen])]
            emit = np.zeros((len(part), SPAN, k), "f4")
            emit[live] = np.add.reduceat(weights[slot], np.cumsum(width[seen]) - width[seen])[back]
            p, a, b, e, live = marginals(emit, trans, lengths[part])
            gold = np.eye(k, dtype="f4")[y[owner[part]]]
            d = np.stack([np.bincount(back, (gold[:, None] - p)[..., j][live], len(seen)) for j in range(k)], 1).astype("f4")
            g = np.stack([np.bincount(slot, d[which, j], SLOTS + 1) for j in range(k)], 1).astype("f4")
            g[SLOTS] = 0
            grad2 += g * g
            weights += 0.1 * g / np.sqrt(grad2)
            pair = a[:, :-1, :, None] * np.exp(trans) * (b * e)[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            on = live[:, 1:, None, None]
            more = (gold[:, None, :, None] * gold[:, None, None, :] * on - pair * on).sum(axis=(0, 1))
            trans += 0.05 * (more / max(1.0, float(on.sum())) * 8 - 0.02 * trans)
    return labels, weights, trans


def quotas(counts: dict[str, int]) -> dict[str, int]:
    """Texts of each label: equal shares of MAX_TRAIN_DOCS, what a label cannot fill going to the others; one at least."""
    left, out = MAX_TRAIN_DOCS, {}
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = max(1, min(n, left // (len(counts) - k)))
        left = max(0, left - out[label])
    return out


def sample(docs: DataFrame, train) -> list[tuple[str, str]]:
    """Distinct whole training texts and their labels, by quotas of labels and a hash of the text.

    A label's texts come in the order of the hash until the next would pass its
    share of MAX_TRAIN_CHARS; the first always comes.
    """
    known = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # one a label
    if not counts:
        return []
    share = quotas(counts)
    # A threshold of the hash lets about twice a label's share through, so neither sort nor driver sees more as tables grow.
    low = lambda y: min((1 << 63) - 1, -(1 << 63) + int(min(1.0, (2 * share[y] + 100) / counts[y]) * (1 << 64)))
    bounds = docs.sparkSession.createDataFrame([(y, low(y)) for y in share], "lang string, most long")
    first = known.join(F.broadcast(bounds), "lang").filter("h <= most").select("lang", "h", "size").distinct()
    chosen, chars, taken = [], dict.fromkeys(share, 0), dict.fromkeys(share, 0)
    for r in sorted(first.collect(), key=lambda r: (r.lang, r.h, r.size)):  # about 2 * MAX_TRAIN_DOCS rows
        full = taken[r.lang] >= share[r.lang] or chars[r.lang] + r.size > MAX_TRAIN_CHARS // len(share)
        if not (taken[r.lang] and full):
            chosen.append((r.lang, r.h, r.size))
            taken[r.lang] += 1
            chars[r.lang] += r.size
    keys = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, h long, size int"))
    rows = known.join(keys, ["lang", "h", "size"]).groupBy("lang", "h").agg(F.min("text").alias("t"))
    return [(r.t, r.lang) for r in sorted(rows.collect(), key=lambda r: (r.h, r.lang))]


def learn(docs: DataFrame, train) -> tuple:
    """Fits on at most MAX_TRAIN_DOCS distinct documents, each label having its share."""
    rows = sample(docs, train)
    return fit(rows) if rows else ([], None, None)


class Judge:
    """Labels texts; the emissions of words stay from call to call."""

    def __init__(self, labels, weights, trans):
        import re

        import numpy as np

        self.labels, self.weights, self.trans, self.find = labels, weights, trans, re.compile(WORD).findall
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(labels)), "f4")
        self.used = 0

    def _learn(self, new: list[str]):
        """Emissions of words not met before; one without letters has the place -1."""
        import numpy as np

        real = [w for w in new if letters(w)]
        self.place.update(dict.fromkeys(new, -1))
        if not real:
            return
        need = self.used + len(real)
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), len(self.labels)), "f4")
            grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        for a in range(0, len(real), 20_000):
            own = real[a : a + 20_000]
            self.rows[self.used : self.used + len(own)] = emissions(own, self.weights)
            self.place.update(zip(own, range(self.used, self.used + len(own))))
            self.used += len(own)

    def __call__(self, texts: list) -> tuple[list[str], list[float]]:
        from itertools import chain

        import numpy as np

        if not self.labels:
            return ["und"] * len(texts), [0.0] * len(texts)
        if self.used > MAX_KNOWN_WORDS:
            self.place, self.used = {}, 0
        found = [self.find(t) if t else [] for t in texts]
        self._learn(list(set().union(*found).difference(self.place)))
        sizes = np.array(list(map(len, found)))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(found)), "i8", int(sizes.sum()))
        if len(at) and at.min() < 0:
            owner = np.repeat(np.arange(len(texts)), sizes)[at >= 0]
            at, sizes = at[at >= 0], np.bincount(owner, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.labels)))
        first, lengths, owner = runs_of(sizes)
        for a in range(0, len(first), 4000):
            f, n = first[a : a + 4000], lengths[a : a + 4000]
            p, *_, live = marginals(self.rows[at[np.minimum(f[:, None] + np.arange(SPAN), len(at) - 1)]], self.trans, n)
            np.add.at(sums, owner[a : a + 4000], (p * live[:, :, None]).sum(axis=1))
        mean = sums / np.maximum(sizes, 1)[:, None]
        named = [self.labels[b] if n else "und" for b, n in zip(mean.argmax(axis=1), sizes)]
        return named, np.where(sizes > 0, np.clip(mean.max(axis=1), 0, 1), 0.0).tolist()


def predict(docs: DataFrame, model) -> DataFrame:
    """All columns of docs, lang_pred and score."""
    narrow(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x labels
    plain = [f"c{i}" for i in range(len(docs.columns))]
    text = plain[docs.columns.index("text")]
    # Columns are numbered on the way, so any names may stand beside the results.
    numbered = docs.toDF(*plain)
    schema = StructType([StructField(f.name, f.dataType) for f in numbered.schema]).add("lang_pred", "string").add("score", "double")

    def tag(batches):
        import pyarrow as pa

        release()
        judge = Judge(*sent.value)
        for batch in batches:
            for part in portions(batch, PORTION, text):
                named, score = judge(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(named, pa.string()), pa.array(score, pa.float64())], names=[*plain, "lang_pred", "score"])

    return numbered.mapInArrow(tag, schema).toDF(*docs.columns, "lang_pred", "score")


def held_out():
    """One document in five, by its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs.select("doc_id", "text"), learn(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
