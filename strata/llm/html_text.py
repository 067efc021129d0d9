"""Main text of pages by consensus host paths.

Every page scores its containers by the share of its clean text (outside links
and junk) that lies in them; shares are summed per host and generalised tag-class
path. A host's path is the deepest that holds nearly all of the host's mass, so
an article split over sections is taken whole; if only the body does, the deepest
that holds half of it. Junk (by element or class) is left out below the path, not
around it: a junk label on what holds nearly a whole page is not believed. A page
without the host's path uses its own best.

Null, empty and textless pages give an empty text. Repeated rows each vote and
are each extracted; pages whose url is null or has no host vote together; of
equal paths the larger hash wins. Pages of any length are read in one pass, in
linear time. Other columns are ignored; an empty table gives an empty result.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import attach, stored
from strata.llm.tokens import portions

#: Hosts' paths are broadcast up to this many and these bytes of names; beyond, the join shuffles, each host spread over SALTS tasks.
MAX_BROADCAST_HOSTS, MAX_BROADCAST_BYTES, SALTS = 200_000, 16 << 20, 32
#: Share of a page that a junk label cannot hide, and shares of a host's mass that its path holds: any path, one below a body.
WHOLE, NEARLY, HALF = 0.9, 0.8, 0.5
# Elements by their role in a page.
DROPPED = frozenset("script style noscript template svg iframe object canvas head title nav header footer aside button select textarea input menu dialog".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body caption dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
JUNK = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])")
NAME, STOP = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile(r"[>\"']")
MARKS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
END_OF = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}


class Page:
    """Blocks of a page, and the tree of its containers and junk parts."""

    def __init__(self, page):
        self.parent, self.path, self.depth, self.own, self.junk, self.wide = [-1], [0], [0], [True], [False], [True]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(page if isinstance(page, str) else "")
        # Clean length of a line; on a page of links alone, all of it.
        self.size = (lambda line, plain: plain) if any(plain for *_, plain in self.blocks) else (lambda line, plain: len(line))
        mass = self._mass(self.blocks)
        self.junk = [j and n < WHOLE * mass[0] for j, n in zip(self.junk, mass)]

    def _node(self, above: int, kind: str | None, junk: bool) -> int:
        """A node below another; without a kind it has no path of its own."""
        from xxhash import xxh3_64_intdigest

        path = self.path[above] if kind is None else xxh3_64_intdigest(kind.encode("utf-8", "surrogatepass"), self.path[above]) >> 1
        self.parent.append(above)
        self.path.append(path)
        self.depth.append(self.depth[above] + (kind is not None))
        self.own.append(kind is not None)
        self.junk.append(junk)
        self.wide.append(kind is not None and kind.split(".")[0] == "body")
        return len(self.parent) - 1

    def _tag_end(self, text: str, at: int) -> int:
        """Where the tag whose name ended here ends; quoted values may hold any character."""
        p = at
        while not self.plain_tags and (q := STOP.search(text, p)):
            if q[0] == ">":
                return q.start()
            k = q.start() - 1
            while k > at and text[k].isspace():
                k -= 1
            close = text.find(q[0], q.end()) if text[k] == "=" else q.start()
            if close < 0:
                break
            p = close + 1
        # A quote that is never closed: from here on tags end at the first >.
        self.plain_tags = True
        return text.find(">", at)

    def _parse(self, text: str) -> None:
        import html
        from collections import Counter

        stack: list[tuple[str, int, bool]] = []  # name, node, hidden
        open_, own, plain, at, last = Counter(), [], 0, 0, text.rfind(">")
        self.plain_tags = False

        def close_block():
            nonlocal plain
            line = " ".join(html.unescape("".join(own)).split()) if own else ""
            if line:
                self.blocks.append((stack[-1][1] if stack else 0, line, min(plain, len(line))))
            own.clear()
            plain = 0

        def pop():
            if stack[-1][0] in BLOCKS:
                close_block()
            open_[stack.pop()[0]] -= 1

        def add(piece):
            nonlocal plain
            if piece and not (stack and stack[-1][2]):
                own.append(piece)
                if not open_["a"]:
                    plain += len(piece.strip())

        while 0 <= (a := text.find("<", at)) < last:
            add(text[at:a])
            if text.startswith("<!--", a):
                end = text.find("-->", a + 4)
                at = end + 3 if end >= 0 else len(text)
                continue
            m = NAME.match(text, a)
            if not m:
                at = a + 1
                if text[at] in "!?/":
                    at = text.find(">", a) + 1
                else:
                    add("<")
                continue
            end = self._tag_end(text, m.end())
            marks_text, name, at = text[m.end() : end], m[2].lower(), end + 1
            if m[1]:
                if open_[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            hidden = bool(stack) and stack[-1][2]
            if name in BLOCKS or name == "hr":
                # An open paragraph ends where a block begins; a list item where the next one does.
                while name not in ("html", "body") and open_["p"] and not hidden:
                    pop()
                if name == "li" and stack and stack[-1][0] == "li":
                    pop()
                if not hidden:
                    close_block()
            elif name == "br":
                add(" ")
            if name in VOID or marks_text.endswith("/") and name in ("svg", "iframe"):
                continue
            marks = {k.lower(): (x or y or z).lower() for k, x, y, z in MARKS.findall(marks_text)}
            junk = name == "form" or name not in ("html", "body", "article", "main") and bool(JUNK.search(" ".join(marks.values())))
            node = stack[-1][1] if stack else 0
            if name in CONTAINERS or junk:
                kind = ".".join([name, *sorted({re.sub(r"\d+", "0", c) for c in marks.get("class", "").split()})])
                node = self._node(node, kind if name in CONTAINERS else None, junk)
            # Junk inside a line never holds the main text.
            stack.append((name, node, hidden or name in DROPPED or junk and name not in BLOCKS))
            open_[name] += 1
            if name in RAW:
                found = END_OF[name].search(text, at)
                at = found.start() if found else len(text)
        # A tag that the page's end cuts off is no text.
        add(re.sub(r"<[a-zA-Z!?/].*\Z", "", text[at:], flags=re.S))
        while stack:
            pop()
        close_block()

    def _mass(self, blocks) -> list[int]:
        """Of each node with all below it."""
        mass = [0] * len(self.parent)
        for node, line, plain in blocks:
            mass[node] += self.size(line, plain)
        for i in range(len(mass) - 1, 0, -1):
            mass[self.parent[i]] += mass[i]
        return mass

    def scores(self) -> dict[int, tuple[float, int, bool]]:
        """Share of the clean text, depth, and whether it is a body, of each path."""
        hidden = [False]
        for up, junk in zip(self.parent[1:], self.junk[1:]):
            hidden.append(hidden[up] or junk)
        clean = self._mass([b for b in self.blocks if not hidden[b[0]]])
        out: dict[int, tuple[float, int, bool]] = {}
        for i, n in enumerate(clean):
            if n and self.own[i]:
                out[self.path[i]] = (out.get(self.path[i], (0.0,))[0] + n / clean[0], self.depth[i], self.wide[i])
        return out

    def text(self, path: int) -> str:
        """Blocks in containers of this path, without junk below it."""
        inside, hidden = [path == 0], [False]
        for i in range(1, len(self.parent)):
            won = self.own[i] and self.path[i] == path
            up = self.parent[i]
            inside.append(won or inside[up])
            hidden.append(not won and (hidden[up] or self.junk[i]))
        return "\n".join(line for node, line, _ in self.blocks if inside[node] and not hidden[node])


def best(tally: dict[int, tuple[float, int, bool]]) -> int:
    """The path of these scores: the deepest that holds nearly all, or half below a body."""
    most = max((s for s, *_ in tally.values()), default=0.0)
    pick = lambda share: max(((d, round(s, 6), p) for p, (s, d, _) in tally.items() if s >= share * most), default=(0, 0, 0))[2]
    path = pick(NEARLY)
    return pick(HALF) if tally and tally[path][2] else path


def extract(html, path: int | None) -> str:
    page = Page(html)
    if path is None or not any(own and p == path for own, p in zip(page.own, page.path)):
        path = best(page.scores())
    return page.text(path)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def vote(batches):
        import pyarrow as pa

        names = ["host", "path", "votes", "depth", "wide"]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.bool_()]
        for batch in batches:
            for part in portions(batch, column="html"):
                tally: dict = {}
                for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    for p, (s, d, wide) in Page(page).scores().items():
                        tally[h, p] = tally.get((h, p), (0.0,))[0] + s, d, wide
                rows = [(h, p, *x) for (h, p), x in tally.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    src = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    each = src.select("host", "html").mapInArrow(vote, "host string, path long, votes double, depth int, wide boolean")
    votes = stored(each.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"), F.first("depth").alias("depth"), F.first("wide").alias("wide")))
    most = votes.groupBy("host").agg(F.max("votes").alias("most"), F.count("*").alias("n"))
    deepest = lambda share: F.max(F.when(F.col("votes") >= share * F.col("most"), F.struct("depth", "votes", "path", "wide")))
    ranked = attach(votes, most, ["host"], votes.count()).groupBy("host").agg(deepest(NEARLY).alias("x"), deepest(HALF).alias("y"))
    chosen = stored(ranked.select("host", F.when(F.col("x.wide"), F.col("y.path")).otherwise(F.col("x.path")).alias("path")))
    hosts, size = chosen.agg(F.count("*"), F.sum(F.octet_length("host") + 8)).first()
    if hosts <= MAX_BROADCAST_HOSTS and (size or 0) <= MAX_BROADCAST_BYTES:
        joined = src.join(F.broadcast(chosen), "host", "left")
    else:
        salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def take(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, column="html"):
                texts = [extract(page, p) for page, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = joined.select("page_id", "url", "html", "path").mapInArrow(take, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
