"""Problem 4: the main body of a page, without menus, notices, sidebars and footers.

Method: union-free regular-expression inference. The pages of a host are read as token streams: the containers of their text
units, in document order. A host's wrapper starts as its first page's stream and is aligned with one page after another:
a token only one side has becomes an optional group, neighbouring equal tokens become a repeated group, and differing texts
become a text slot. The wrapper's region that holds the page's heading is the main body. Within it every group of the expression gets a role from
its own slot: a group whose slot keeps repeating the same texts (breadcrumbs, share and print prompts) is furniture, at that
place of the page only: the same container may be furniture before the heading and body after it. Each page is then matched against its host's wrapper, each text unit takes the role of the group it falls on, and each line
of the extracted text the role of its unit. A line that the cut-off markup lacks is furniture if the host's other pages, or
several hosts, have it as furniture.

Cost: markup is read once, where it lies, and never moves: that pass writes the pages' token runs and text keys, and one
small wrapper a host and partition, which are merged (in rounds of at most ``FAN_IN`` where a host has more). What comes back to
the written runs is one row of roles a host, through a size-checked join. Statistics in a wrapper are counts and fixed-size
sketches that estimate distinct texts. An expression holds at most ``MAX_ITEMS`` groups; the counts of rarer tokens are kept by container
instead, without a limit, and units of theirs take the role of their container. Long numbers in attributes do not tell containers apart.

Defined results: null or empty text has no lines; a page without markup, or without a recognisable main region, has only
lines known as furniture elsewhere; cut-off, unclosed and empty markup is read as far as it goes; empty lines are never
cases; where one text stands in several regions its occurrences are taken in document order.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import cut, join_small

FAN_IN = 256
MAX_ITEMS = 256
SKETCH = 64
#: A group in the main body is furniture if of this many units at most this share are distinct; one in no marked container
#: must stand before the heading and repeat far more, as a page may have been fetched several times.
FEW_UNITS, REPEATED, REPEATED_PLAIN = 12, 0.5, 0.1
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|title|template)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|style|data-[\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_INLINE = frozenset("a b i u s em strong span small_ sub sup font_ label code abbr cite q time mark tt big".split())
_LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd pre".split())
_PLAIN = _LEAF | frozenset("ul ol".split())
_VOID = frozenset("br img hr meta link input wbr source".split())
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d{3,}")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _signature(tag: str, attributes: str) -> str:
    found = _ATTRIBUTE.findall(attributes) if attributes else ()
    return tag + "".join(f"[{k.lower()}={_DIGITS.sub('#', (a or b or c).strip().lower())}]" for k, a, b, c in found)


def text_units(markup: str) -> tuple[list[tuple[tuple[str, ...], str]], bool]:
    """((containers, text) of each block of text in document order, whether the markup was cut off)."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, str]] = []
    filled: set[int] = set()
    buffer: list[str] = []
    low = markup.lower()
    inside = "<body" not in low

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((tuple(s for _, s in stack), text))
                filled.add(len(stack))

    for m in _TOKEN.finditer(markup):
        text = m.group(5)
        if text is not None:
            if inside:
                buffer.append(text)
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag, close = tag.lower(), m.group(2)
        if tag == "body":
            flush()
            inside = not close
            continue
        if not inside or (tag in _INLINE and (stack or tag != "span")):
            continue
        if tag in _VOID:
            buffer.append(" ")
            continue
        flush()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            if tag in _LEAF and stack and stack[-1][0] in _LEAF and len(stack) in filled:
                stack.pop()
            filled.discard(len(stack) + 1)
            stack.append((tag, _signature(tag, m.group(4))))
    flush()
    return out, "</body" not in low


def region(path: tuple[str, ...]) -> tuple[str, str]:
    """(top, marked): the outermost container, and the innermost one below it that carries attributes, if any."""
    if not path:
        return "", ""
    marked = ""
    for sig in path[1:]:
        if "[" in sig or sig.split("[")[0] not in _PLAIN and sig not in ("div", "table", "tr", "td", "tbody", "dl"):
            marked = sig
    return path[0], marked


def _tokens(units: list[tuple[tuple[str, ...], str]]) -> list[tuple[str, list[str]]]:
    """The page's stream with neighbouring equal tokens joined: (token, texts)."""
    out: list[tuple[str, list[str]]] = []
    for path, text in units:
        top, marked = region(path)
        token = f"{top}\t{marked}\t{'h1' if any(s.startswith('h1') for s in path) else ''}"
        if out and out[-1][0] == token:
            out[-1][1].append(text)
        else:
            out.append((token, [text]))
    return out


def aligned(a: list[str], b: tuple[str, ...]) -> list[int]:
    """For each of ``b`` its place in ``a`` under a longest common subsequence, or -1."""
    start, end = 0, 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, xi = best[i], best[i + 1], x[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if xi == y[j] else max(below[j], row[j + 1])
    out, i, j = list(range(start)), 0, 0
    while j < m:
        if i < n and x[i] == y[j]:
            out.append(start + i)
            i, j = i + 1, j + 1
        elif i == n or best[i][j + 1] >= best[i + 1][j]:
            out.append(-1)
            j += 1
        else:
            i += 1
    return out + list(range(len(a) - end, len(a)))


class Wrapper:
    """A union-free regular expression: a sequence of tokens, each optional or not, repeated or not, with a constant text or a slot."""

    def __init__(self) -> None:
        self.pages = 0
        self.items: list[dict] = []
        #: Counts of tokens that are too rare for the expression, by token.
        self.rest: dict[str, dict] = {}
        self.known: dict[tuple[str, ...], list[int]] = {}

    def _align(self, tokens: tuple[str, ...]) -> list[int]:
        """Place of each token among the items, which are extended by what is missing; items passed over become optional."""
        found = self.known.get(tokens)
        if found is not None:
            return found
        at = aligned([i["t"] for i in self.items], tokens)
        merged, places, i = [], [], 0
        for j, place in enumerate(at):
            if place >= 0:
                while i < place:
                    self.items[i]["o"] = True
                    merged.append(self.items[i])
                    i += 1
                merged.append(self.items[i])
                i += 1
            else:
                merged.append({"t": tokens[j], "o": self.pages > 0, "r": False, "p": 0, "u": 0, "c": 0, "x": None, "k": []})
            places.append(len(merged) - 1)
        for item in self.items[i:]:
            item["o"] = True
            merged.append(item)
        self.items = merged
        if -1 in at:
            self.known.clear()
        self.known[tokens] = places
        return places

    @staticmethod
    def _sketch(item: dict, more: list[int]) -> None:
        held = set(item["k"])
        held.update(more)
        item["k"] = sorted(held)[:SKETCH] if len(held) > SKETCH else list(held)

    def add_page(self, units: list[tuple[tuple[str, ...], str]]) -> None:
        stream = _tokens(units)
        if not stream:
            return
        for place, (_, texts) in zip(self._align(tuple(t for t, _ in stream)), stream):
            item = self.items[place]
            keys = [xxhash.xxh3_64_intdigest(_NOT_LETTERS.sub("", t.lower())) >> 1 for t in texts]
            if item["p"] == 0:
                item["x"] = texts[0] if len(texts) == 1 else None
            elif item["x"] is not None and [item["x"]] != texts:
                item["x"] = None
            item["r"] = item["r"] or len(texts) > 1
            item["p"] += 1
            item["u"] += len(texts)
            item["c"] += sum(map(len, texts))
            if len(item["k"]) < SKETCH or min(keys) < item["k"][-1]:
                self._sketch(item, keys)
                item["k"].sort()
        self.pages += 1
        self._limit()

    def add_wrapper(self, other: Wrapper) -> None:
        for place, theirs in zip(list(self._align(tuple(i["t"] for i in other.items))), other.items):
            item = self.items[place]
            if item["p"] == 0:
                item.update({k: theirs[k] for k in "orpucxk"}, o=theirs["o"] or self.pages > 0)
                continue
            item["x"] = item["x"] if item["x"] == theirs["x"] else None
            item["o"], item["r"] = item["o"] or theirs["o"], item["r"] or theirs["r"]
            for k in "puc":
                item[k] += theirs[k]
            self._sketch(item, theirs["k"])
        for item in other.rest.values():
            self._keep(item)
        self.pages += other.pages
        self._limit()

    def _limit(self) -> None:
        """Keep the commonest items; what the others counted stays, by token."""
        if len(self.items) > MAX_ITEMS:
            kept = set(sorted(range(len(self.items)), key=lambda i: -self.items[i]["p"])[: MAX_ITEMS * 3 // 4])
            for i, item in enumerate(self.items):
                if i not in kept:
                    self._keep(item)
            self.items = [x for i, x in enumerate(self.items) if i in kept]
            self.known.clear()

    def _keep(self, item: dict) -> None:
        held = self.rest.setdefault(item["t"], {"t": item["t"], "p": 0, "u": 0, "c": 0, "k": []})
        for k in "puc":
            held[k] += item[k]
        self._sketch(held, item["k"])

    def dump(self) -> str:
        return json.dumps({"pages": self.pages, "items": self.items, "rest": list(self.rest.values())}, ensure_ascii=False)

    @staticmethod
    def load(text: str) -> Wrapper:
        w, data = Wrapper(), json.loads(text)
        w.pages, w.items, w.rest = data["pages"], data["items"], {i["t"]: i for i in data["rest"]}
        return w

    def pattern(self) -> str:
        """The expression in words: ``?`` optional, ``+`` repeated, a constant in quotes or a SLOT."""
        parts = []
        for i in self.items:
            top, marked, h1 = i["t"].split("\t")
            body = f"{'>'.join(x for x in (top, marked, h1) if x)}:{json.dumps(i['x'], ensure_ascii=False) if i['x'] is not None else 'SLOT'}"
            parts.append(f"({body})" + ("+" if i["r"] else "") + ("?" if i["o"] else ""))
        return " ".join(parts)


def distinct_texts(sketch: list[int]) -> float:
    return float(len(sketch)) if len(sketch) < SKETCH else (SKETCH - 1) / (max(sketch) / 2**63)


def host_of(domain: Column, url: Column) -> Column:
    own = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.coalesce(F.when(domain != "", domain), own, F.lit(""))), r":\d*$", "")


_PAGE = T.StructType(
    [
        T.StructField("wrapper", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("cut_off", T.BooleanType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("chars", T.ArrayType(T.LongType())),
        T.StructField("units", T.BinaryType()),
        T.StructField("lines", T.BinaryType()),
    ]
)
_LINE = np.dtype([("no", "<i8"), ("key", "<i8"), ("letters", "<i8"), ("tail", "<i8")])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _letters_key(text: str) -> int:
    return _hash(_NOT_LETTERS.sub("", text.lower()))


def read_pages(pages: DataFrame, page_id: str, domain: str, url: str, markup: str, text: str) -> DataFrame:
    """One row for each page with an id and text: its token runs (token, units, characters), the keys of its units and lines; and
    one row for each host of a partition with its wrapper. The only pass over the markup."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in _PAGE.fields]
        held: dict[str, Wrapper] = {}
        part = 0
        for pdf in batches:
            out = []
            part = int(pdf["part"].iloc[0]) if len(pdf) else part
            for host, i, x, t in zip(pdf["host"], pdf["page_id"], pdf["markup"], pdf["text"]):
                units, cut_off = text_units(x) if x else ([], True)
                if x:
                    held.setdefault(host, Wrapper()).add_page(units)
                if not t or i is None or i != i:
                    continue
                runs = _tokens(units)
                tail = units[-1][1] if units and cut_off else ""
                lines = []
                for no, line in enumerate(t.split("\n"), 1):
                    key = line_key(line)
                    if key:
                        lines.append((no, _hash(key), _letters_key(line), int(len(tail) >= 5 and key.startswith(tail))))
                out.append(
                    (
                        None, part, host, int(i), cut_off, [k for k, _ in runs], [len(ts) for _, ts in runs], [sum(map(len, ts)) for _, ts in runs],
                        np.array([_hash(line_key(u)) for _, u in units], "<i8").tobytes(), np.array(lines, _LINE).tobytes(),
                    )
                )
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(w.dump(), part, h, *[None] * (len(names) - 3)) for h, w in held.items()], columns=names, dtype=object)

    picked = pages.where((F.length(markup) > 0) | (F.length(text) > 0)).select(
        host_of(F.col(domain), F.col(url)).alias("host"),
        F.col(page_id).cast("long").alias("page_id"),
        F.col(markup).alias("markup"),
        F.col(text).alias("text"),
        F.spark_partition_id().cast("long").alias("part"),
    )
    return cut(picked.mapInPandas(run, _PAGE), "p4-pages")


def merge_wrappers(read: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON, from ``read_pages``."""

    def merge(key, pdf):
        whole = Wrapper()
        for text in pdf.sort_values("part")["wrapper"]:
            whole.add_wrapper(Wrapper.load(text))
        return pd.DataFrame({"host": [key[0]], "part": [int(key[1])], "wrapper": [whole.dump()]})

    schema = "host string, part long, wrapper string"
    partial = read.where(F.col("wrapper").isNotNull()).select("host", "part", "wrapper")
    most = partial.agg(F.max("part").alias("m")).first()["m"] or 0
    while most >= FAN_IN:
        partial = cut(
            partial.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("host", "part").applyInPandas(merge, schema),
            "p4-partial",
        )
        most //= FAN_IN
    return cut(
        partial.withColumn("_one", F.lit(0)).groupBy("host", "_one").applyInPandas(merge, schema).select("host", "wrapper"),
        "p4-wrappers",
    )


def infer_wrappers(
    pages: DataFrame,
    page_id: str = "page_id",
    domain: str = "domain",
    url: str = "url",
    markup: str = "html_content",
    text: str = "clean_content",
) -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON."""
    return merge_wrappers(read_pages(pages, page_id, domain, url, markup, text))


def group_roles(wrappers: DataFrame) -> DataFrame:
    """(host, main_top, groups, furniture): the outermost container of the main body; the expression's groups in order, each with
    its token and whether it is furniture; and the marked containers that are, for units that fall on no group."""

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for host, text in zip(pdf["host"], pdf["wrapper"]):
                whole = Wrapper.load(text)
                for no, i in [*enumerate(whole.items), *((-1, i) for i in whole.rest.values())]:
                    top, marked, h1 = i["t"].split("\t")
                    out.append((host, no, i["t"], top, marked, h1 != "", i["p"], i["u"], i["c"], distinct_texts(i["k"])))
            yield pd.DataFrame(out, columns=["host", "no", "token", "top", "marked", "h1", "pages", "units", "chars", "distinct"])

    table = cut(
        wrappers.mapInPandas(
            items,
            "host string, no long, token string, top string, marked string, h1 boolean, pages long, units long, chars long, distinct double",
        ),
        "p4-items",
    )
    share = lambda d, u: F.least(d, u) / u
    tops = table.groupBy("host", "top").agg(F.sum(F.when(F.col("h1"), F.col("pages")).otherwise(0)).alias("h1"), F.sum("chars").alias("chars"))
    main = tops.groupBy("host").agg(F.max_by("top", F.struct("h1", "chars", "top")).alias("main_top"))
    heading = table.where(F.col("h1") & (F.col("no") >= 0)).groupBy("host", F.col("top").alias("main_top")).agg(F.max_by("no", "pages").alias("heading"))
    placed = table.join(main.join(heading, ["host", "main_top"], "left"), "host")
    own = placed.where((F.col("marked") != "") & (F.col("top") == F.col("main_top"))).groupBy("host", "marked").agg(
        F.sum("units").alias("own_units"), F.sum("distinct").alias("own_distinct")
    )
    library = own.groupBy("marked").agg((F.sum(F.least("own_distinct", "own_units")) / F.sum("own_units")).alias("ratio"))
    container = own.join(library, "marked").select(
        "host",
        "marked",
        (F.when(F.col("own_units") >= FEW_UNITS, share(F.col("own_distinct"), F.col("own_units"))).otherwise(F.col("ratio")) <= REPEATED).alias("container"),
    )
    enough, repeats = F.col("units") >= FEW_UNITS, share(F.col("distinct"), F.col("units"))
    role = (
        (F.col("top") != F.col("main_top"))
        | F.when(F.col("marked") != "", F.when(enough, repeats <= REPEATED).otherwise(F.coalesce("container", F.lit(False)))).otherwise(
            F.coalesce(F.col("no") < F.col("heading"), F.lit(False)) & enough & (repeats <= REPEATED_PLAIN)
        )
    )
    groups = placed.where("no >= 0").join(container, ["host", "marked"], "left").groupBy("host", "main_top").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("no", "token", role.alias("furniture")))), lambda g: F.struct(g["token"].alias("token"), g["furniture"].alias("furniture"))).alias("groups")
    )  # at most MAX_ITEMS groups a host
    sets = container.where("container").groupBy("host").agg(F.collect_set("marked").alias("furniture"))
    return groups.join(sets, "host", "left")


def line_key(line: str) -> str:
    line = _SPACE.sub(" ", line).strip()
    return line[2:] if line.startswith("- ") else line


class Roles:
    """A host's groups and containers, with the places of token sequences met before."""

    def __init__(self, main_top: str | None, groups, furniture) -> None:
        self.main_top = main_top
        self.tokens = [g["token"] for g in groups] if groups is not None else []
        self.roles = [bool(g["furniture"]) for g in groups] if groups is not None else []
        self.furniture = frozenset(furniture) if furniture is not None else frozenset()
        self.known: dict[tuple[str, ...], list[bool]] = {}

    def of_page(self, tokens: tuple[str, ...], sizes: list[int], cut_off: bool) -> tuple[list[bool], bool]:
        """(whether each run is furniture, whether the page has a main region): the page matched against the wrapper."""
        parts = [t.split("\t") for t in tokens]
        with_h1 = next((top for top, _, h1 in parts if h1), None)
        tops = {top for top, _, _ in parts}
        main = self.main_top if self.main_top in tops and with_h1 in (None, self.main_top) else with_h1
        if main is None and parts and not cut_off:
            weight: dict[str, int] = {}
            for (top, _, _), n in zip(parts, sizes):
                weight[top] = weight.get(top, 0) + n
            main = max(sorted(weight), key=lambda k: weight[k])
        if main is None:
            return [False] * len(parts), False
        if main != self.main_top:
            return [top != main or marked in self.furniture for top, marked, _ in parts], True
        found = self.known.get(tokens)
        if found is None:
            if len(self.known) > 4096:
                self.known.clear()
            found = self.known[tokens] = [
                self.roles[place] if place >= 0 else top != main or marked in self.furniture
                for place, (top, marked, _) in zip(aligned(self.tokens, tokens), parts)
            ]
        return found, True


def label_lines(units: np.ndarray, lines: np.ndarray, roles: list[bool], known_main: bool, cut_off: bool) -> list[tuple[int, int, bool, bool]]:
    """(line_no, letters, known, hint) of each line that is furniture (known) or not in the markup; hint: such a line in furniture's place.
    ``roles`` has one role a unit."""
    held: dict[int, list[bool]] = {}
    for key, role in zip(units.tolist(), roles):
        held.setdefault(key, []).append(role)
    for r in held.values():
        r.reverse()
    tail = bool(roles[-1]) if roles and cut_off else False
    out, before = [], False
    for no, key, letters, is_tail in lines.tolist():
        r = held.get(key)
        if r:
            before = r.pop() if len(r) > 1 else r[0]
            if before:
                out.append((no, letters, True, False))
        elif is_tail:
            before = tail
            if before:
                out.append((no, letters, True, False))
        else:
            before = before and cut_off and known_main and tail
            out.append((no, letters, False, before))
    return out


def furniture_lines(
    pages: DataFrame,
    page_id: str = "page_id",
    domain: str = "domain",
    url: str = "url",
    markup: str = "html_content",
    text: str = "clean_content",
) -> DataFrame:
    """(page_id, line_no): the lines of ``text`` that are page furniture."""
    read = read_pages(pages, page_id, domain, url, markup, text)
    roles = cut(group_roles(merge_wrappers(read)), "p4-roles")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts: dict[str, Roles] = {}
        for pdf in batches:
            out = []
            for i, host, cut_off, tokens, sizes, chars, units, lines, top, groups, marked in zip(
                *(pdf[c] for c in ("page_id", "host", "cut_off", "tokens", "sizes", "chars", "units", "lines", "main_top", "groups", "furniture"))
            ):
                if host not in hosts:
                    if len(hosts) > 2000:
                        hosts.clear()
                    hosts[host] = Roles(top, groups, marked)
                by_run, known_main = hosts[host].of_page(tuple(tokens), chars, cut_off)
                by_unit = [r for r, n in zip(by_run, sizes) for _ in range(int(n))]
                found = label_lines(np.frombuffer(units, "<i8"), np.frombuffer(lines, _LINE), by_unit, known_main, cut_off)
                out += [(i, no, host, letters, known, hint) for no, letters, known, hint in found]
            yield pd.DataFrame(out, columns=["page_id", "line_no", "host", "key", "known", "hint"])

    picked = read.where(F.col("wrapper").isNull()).select("page_id", "host", "cut_off", "tokens", "sizes", "chars", "units", "lines")
    labelled = cut(
        join_small(picked, roles, ["host"], "left", row_bytes=16_000).mapInPandas(
            label,
            "page_id long, line_no long, host string, key long, known boolean, hint boolean",
        ),
        "p4-lines",
    )
    unknown = labelled.where(~F.col("known"))
    wanted = unknown.select("key").distinct()
    seen = join_small(labelled.where("known").select("host", "key"), wanted, ["key"], row_bytes=24).distinct()
    here = seen.withColumn("_here", F.lit(True))
    wide = seen.groupBy("key").agg(F.count(F.lit(1)).alias("_hosts"))
    late = unknown.join(here, ["host", "key"], "left").join(wide, "key", "left").where(
        F.col("hint") | F.col("_here") | (F.col("_hosts") >= 3)
    )
    return labelled.where("known").select("page_id", "line_no").unionByName(late.select("page_id", "line_no")).distinct()


def main_bodies(pages: DataFrame, page_id: str = "page_id", text: str = "clean_content", **columns: str) -> DataFrame:
    """All rows and columns of ``pages``, with the furniture lines taken out of ``text`` and ``n_furniture_lines`` added."""
    found = furniture_lines(pages, page_id=page_id, text=text, **columns).groupBy(F.col("page_id").alias("_quern_id")).agg(
        F.collect_set("line_no").alias("_quern_gone")
    )
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_quern_gone", (i + 1).cast("long"))), "\n")
    out = pages.join(found, F.col(page_id) == F.col("_quern_id"), "left")
    return out.withColumn(text, F.when(F.col("_quern_gone").isNull(), F.col(text)).otherwise(kept)).withColumn(
        "n_furniture_lines",
        F.when(F.col("_quern_gone").isNull(), 0).otherwise(F.size("_quern_gone")),
    ).drop("_quern_id", "_quern_gone")
