"""Main text of web pages through wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and texts, which a lenient parser nests. All pages of a host are aligned: pages of one
structure are laid over each other first, then structures are merged as a tree. Where neighbours in a stream repeat, they become a repeated group; what only some pages have becomes
optional; texts that differ become slots, texts that agree stay as they are. The result is the host's wrapper. On the way there
is one for each of the host's templates, that is pages with the same containers; the part that holds the article is
found in that one, and every page of the template is read there. A block is template text, and left out, where all its
texts are constant in the host's wrapper; slots stay.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Wrappers that one step of the tree merges, about; bytes up to which what is found is shared with all executors
#: (beyond, it is joined by host); structures that a task holds before it passes them on.
FAN, SHARED_BYTES, HELD = 64, 64 << 20, 2000
#: Different pages that must agree on a text before it counts as template: copies of one article agree on all of it.
LEAST = 8
#: Elements nested in each other; none of the texts deeper down is lost.
DEEPEST = 200

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|(?:[^<]|<(?![A-Za-z/!?]))+|<""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# fixed values: element names of the HTML standard
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object select option button".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_ENDS_P = _BLOCK - frozenset("body head html li dd dt td th tr tbody thead tfoot title figcaption".split()) | {"p"}
_ALONE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "th", "table", "button"}}
_APART = frozenset("nav aside footer header form script style noscript template head title button select textarea iframe svg math object dialog menu".split())
_APART_WORDS = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer header masthead cookie cookies consent notice alert popup modal newsletter subscribe signup login search share sharing social related recommended comment comments disqus replies reply pagination pager toc copyright legal disclaimer".split())
_MAIN_WORDS = frozenset("article main content post entry story body text".split())
_HOLDERS = frozenset("article center div main section table td".split())

Node = list  # [symbol, tag, children]; a child is a Node or a str


def parse(page: str) -> Node:
    """The page's tree. Wrong nesting is mended: an end tag closes what is open inside it, or nothing."""
    root: Node = ["#", "#", []]
    stack, still = [root], {}  # open elements, and how many of each name
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        if at > last:  # no tag can end here any more
            stack[-1][2].append(page[at:] if not page.startswith("<!--", at) else "")
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            raw = m.group()
            if raw[0] != "<" or raw == "<":
                stack[-1][2].append(raw)
            elif raw.startswith("<![CDATA["):
                stack[-1][2].append(entities.escape(raw[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if still.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == tag:
                        _cut(stack, k, still)
                        break
            continue
        attributes = m.group(3) or m.group(6) or ""
        if tag in _ENDS_P:
            _close(stack, {"p"}, _SCOPE["p"], still)
        if tag in _ALONE:
            _close(stack, _ALONE[tag], _SCOPE[tag], still)
        symbol = tag
        if attributes and "=" in attributes:
            named = [" ".join(sorted(set(re.sub(r"\d+", "", next(g for g in x.groups()[1:] if g is not None)).lower().split()))) for x in _NAMED.finditer(attributes)]
            symbol = ".".join([tag, *filter(None, named)])
        if len(stack) > DEEPEST:  # what lies deeper stands in its ancestor, as in browsers, which also nest to a limit
            node: Node = [symbol, tag, stack[-1][2]]
        else:
            node = [symbol, tag, []]
            stack[-1][2].append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag in ("script", "style", "textarea", "title", "iframe", "noscript", "template"):
                at = end.end() if end else (n if tag in ("script", "style") else at)
                continue
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            still[tag] = still.get(tag, 0) + 1
    return root


def _cut(stack: list[Node], k: int, still: dict[str, int]) -> None:
    for x in stack[k:]:
        still[x[1]] -= 1
    del stack[k:]


def _close(stack: list[Node], names: set[str], scope: set[str], still: dict[str, int]) -> None:
    if not any(still.get(x) for x in names):
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][1] in names:
            _cut(stack, k, still)
            return
        if stack[k][1] in scope:
            return


# ---- wrappers -------------------------------------------------------------------------------------------------------
# An item is [symbol, least, most, kids, chars]: least is 0 for what may be missing, most is 2 for what repeats. The
# symbol of a text slot is "#text", with the text itself as kids while all pages agree on it; that of a repeated group
# of several items is the tuple of theirs. chars: how much text pages have there. Of marked pages, a text slot holds a
# digest of text and path in place of the text, and a sixth value: marks of at most LEAST pages that agree on it.


def _digest(path: str, text: str) -> bytes:
    return hashlib.blake2b(f"{path}\0{text}".encode(errors="surrogatepass"), digest_size=8).digest()


def _mark(root: Node) -> bytes:
    """Digest of the two longest texts that may be an article's: copies of an article have one mark."""
    texts: set[str] = set()

    def walk(node: Node) -> None:
        for c in node[2]:
            if isinstance(c, str):
                texts.add(" ".join(c.split()))
            elif not apart(c[0], True):
                walk(c)

    walk(root)
    return _digest("", "\0".join(sorted(texts, key=lambda t: (-len(t), t))[:2]))


def _generalised(node: Node, mark: bytes | None = None, path: str = "") -> list:
    kids, chars = [], 0
    for child in node[2]:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                kids.append(["#text", 1, 1, text, len(text)] if mark is None else ["#text", 1, 1, _digest(path, text), len(text), (mark,)])
                chars += len(text)
        else:
            kid = _generalised(child, mark, f"{path}/{child[0]}")
            kids.append(kid)
            chars += kid[4]
    return [node[0], 1, 1, _fold(kids), chars]


def _fold(items: list, longest: int = 4) -> list:
    """Neighbours that repeat become one repeated item, or one repeated group."""
    for size in range(1, longest + 1):
        out, i = [], 0
        while i < len(items):
            run = [x[0] for x in items[i : i + size]]
            j = i + size
            if len(run) == size and run[0] != "#text":
                while [x[0] for x in items[j : j + size]] == run:
                    j += size
            if j > i + size:
                groups = [items[k : k + size] for k in range(i, j, size)]
                first = groups[0]
                for g in groups[1:]:
                    first = [_merge(a, b) for a, b in zip(first, g, strict=True)]
                if size == 1:
                    out.append([first[0][0], first[0][1], 2, first[0][3], sum(g[0][4] for g in groups)])
                else:
                    out.append([tuple(run), 1, 2, first, sum(x[4] for g in groups for x in g)])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _merge(a: list, b: list) -> list:
    """The least general item that covers both, which have one symbol."""
    least, most, chars = min(a[1], b[1]), max(a[2], b[2]), a[4] + b[4]
    if a[0] == "#text":
        same = a[3] if a[3] == b[3] else None
        marks = [() if same is None else tuple(sorted({*a[5], *b[5]})[:LEAST])] if len(a) > 5 else []
        return ["#text", least, most, same, chars, *marks]
    return [a[0], least, most, _align(a[3], b[3]), chars]


def _align(a: list, b: list) -> list:
    """Both streams as one: the longest common run of symbols is merged, the rest becomes optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 0, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 0, *b[j][2:]])
            j += 1
    return _fold(out)


def infer(pages: list[str]) -> list:
    """The wrapper of the pages, aligned one after another."""
    wrapper = None
    for page in pages:
        own = _generalised(parse(page))
        wrapper = own if wrapper is None else _merge(wrapper, own)
    return wrapper


def structure(item: list) -> list:
    """The wrapper without its texts."""
    return [*item[:3], [structure(x) for x in item[3]] if isinstance(item[3], list) else None]


def overlay(a: list, b: list) -> list:
    """Two wrappers of one structure as one; in whatever order several are laid over each other, the result is one."""
    if a[0] == "#text":
        return _merge(a, b)
    return [*a[:3], [overlay(x, y) for x, y in zip(a[3], b[3], strict=True)], a[4] + b[4]]


def aligned(wrappers: list[tuple[int, list]]) -> list:
    """One wrapper of (structure, wrapper), the same whatever their order."""
    whole: dict[int, list] = {}
    for key, w in wrappers:
        whole[key] = overlay(whole[key], w) if key in whole else w
    out = None
    for key in sorted(whole):
        out = whole[key] if out is None else _merge(out, whole[key])
    return out


def template_of(root: Node) -> int:
    """The page's template: a hash of the paths of all containers in which an article could stand."""
    found: set[str] = set()

    def walk(node: Node, path: str) -> None:
        for c in node[2]:
            if not isinstance(c, str) and not apart(c[0], False):
                own = f"{path}/{c[0]}"
                if c[1] in _HOLDERS:
                    found.add(own)
                walk(c, own)

    walk(root, "")
    return int.from_bytes(_digest("", "\0".join(sorted(found))), "big", signed=True)


def regular_expression(item: list) -> str:
    """The wrapper as text, with ? * + and (...) in their usual meanings."""
    sign = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[item[1], item[2]]
    if item[0] == "#text":
        return ("#PCDATA" if item[3] is None else entities.escape(item[3])) + sign
    inner = " ".join(regular_expression(x) for x in item[3])
    if isinstance(item[0], tuple):
        return f"({inner}){sign}"
    return f"(<{item[0]}> {inner} </>){sign}" if sign else f"<{item[0]}> {inner} </>"


def _words(symbol: str) -> set[str]:
    return {w for part in symbol.split(".")[1:] for w in re.split(r"[\s_-]+", part)}


def apart(symbol: str, inside: bool) -> bool:
    """Whether an element is no part of an article. Inside one, a header element is the article's own."""
    tag = symbol.partition(".")[0]
    if tag in _APART and not (inside and tag == "header"):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    found = _words(symbol)
    bad = found & _APART_WORDS
    return bool(bad) and not (inside and bad == {"header"} and found & _MAIN_WORDS)


def article_path(wrapper: list) -> tuple[str, ...] | None:
    """The symbols from the root to the item that holds the article."""
    named: list[tuple[int, int, tuple[str, ...]]] = []
    plain: list[tuple[int, int, tuple[str, ...]]] = []

    def volume(item: list) -> int:
        if item[0] == "#text":
            return item[4]
        if isinstance(item[0], str) and apart(item[0], True):
            return 0
        return item[4] if not item[3] else sum(volume(x) for x in item[3]) or 0

    def walk(item: list, path: tuple[str, ...]) -> None:
        for x in item[3] if isinstance(item[3], list) else []:
            if x[0] == "#text":
                continue
            if isinstance(x[0], tuple):
                walk(x, path)
                continue
            if apart(x[0], False):
                continue
            own, amount, tag = (*path, x[0]), volume(x), x[0].partition(".")[0]
            if amount:
                if tag in ("article", "main") or tag in ("div", "section", "td") and not _words(x[0]).isdisjoint(_MAIN_WORDS):
                    named.append(({"article": 2, "main": 1}.get(tag, 0), amount, own))
                plain.append((len(own), amount, own))
            walk(x, own)

    walk(wrapper, ())
    if named:
        return max(named, key=lambda x: (x[0], x[1], -len(x[2])))[2]
    if not plain:
        return None
    whole = max(a for _, a, _ in plain)
    tags = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote"}
    held = [x for x in plain if x[1] >= 0.8 * whole and x[2][-1].partition(".")[0] in tags]
    return max(held)[2] if held else None


def constants(wrapper: list) -> frozenset[bytes]:
    """Digests of the texts that the wrapper of marked pages knows to be template."""
    out: set[bytes] = set()

    def walk(item: list) -> None:
        for x in item[3]:
            if x[0] != "#text":
                walk(x)
            elif x[3] is not None and len(x[5]) >= LEAST:
                out.add(x[3])

    walk(wrapper)
    return frozenset(out)


def places(root: Node, path: tuple[str, ...]) -> list[Node]:
    """The nodes of the page at the path; several where its last item repeats."""
    level = [root]
    for symbol in path:
        level = [c for x in level for c in x[2] if not isinstance(c, str) and c[0] == symbol]
    return level


def blocks(node: Node, out: list[str] | None = None, template: frozenset[bytes] = frozenset(), path: str = "") -> list[str]:
    """The texts of the node's blocks in order, references decoded and white space made single. Left out are blocks
    whose texts are all template; path is the node's."""
    held: list[str] = []
    slot = False
    out = [] if out is None else out

    def end() -> None:
        nonlocal slot
        text = " ".join("".join(held).split())
        held.clear()
        if text and (slot or not template):
            out.append(text)
        slot = False

    def walk(x: Node, path: str) -> None:
        nonlocal slot
        for c in x[2]:
            if isinstance(c, str):
                held.append(entities.unescape(c))
                if template and not slot:
                    text = " ".join(c.split())
                    slot = bool(text) and _digest(path, text) not in template
            elif c[1] == "br":
                held.append(" ")
            elif apart(c[0], True):
                if c[1] in _BLOCK:
                    end()
            elif c[1] in _BLOCK:
                end()
                walk(c, f"{path}/{c[0]}")
                end()
            else:
                walk(c, f"{path}/{c[0]}")

    walk(node, path)
    end()
    return out


def extract(page: str | None, paths: dict[int, tuple[str, ...] | None], template: frozenset[bytes] = frozenset()) -> str:
    """The main text of a page at its template's path, or at its own where the page has no such place. A page with
    nothing but template text there keeps it."""
    if not page:
        return ""
    root = parse(page)
    path = paths.get(template_of(root))
    found = places(root, path) if path else []
    if not found:
        path = article_path(_generalised(root))
        found = places(root, path) if path else [root]
    at = "".join(f"/{symbol}" for symbol in path or ())
    out: list[str] = []
    for known in (template, frozenset()) if template else (template,):
        for node in found:
            blocks(node, out, known, at)
        if out:
            break
    return "\n".join(out)


def _shapes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, template, shape, wrapper: the task's pages (html, host), those of one structure laid over each other."""
    held: dict[tuple[str, int, int], list] = {}

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array([pickle.dumps(w) for w in held.values()], pa.binary())], ["host", "template", "shape", "wrapper"])
        held.clear()
        return out

    for b in it:
        for page, host in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            page = page.as_py()
            if not page:
                continue
            root = parse(page)
            own = _generalised(root, _mark(root))
            key = host, template_of(root), int.from_bytes(_digest("", repr(structure(own))), "big", signed=True)
            held[key] = overlay(held[key], own) if key in held else own
            if len(held) >= HELD:
                yield flush()
    yield flush()


def _aligned(table: pa.Table) -> pa.Table:
    """The rows of one group as one, under the least shape."""
    shapes = table["shape"].to_pylist()
    wrapper = aligned([(k, pickle.loads(w)) for k, w in zip(shapes, table["wrapper"].to_pylist(), strict=True)])
    return pa.table({"host": table["host"].slice(0, 1), "template": table["template"].slice(0, 1), "shape": pa.array([min(shapes)], pa.int64()), "wrapper": pa.array([pickle.dumps(wrapper)], pa.binary())})


def main_text(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html gives an empty text. A url without a host, or null, counts as of one nameless host. Repeated
    rows and null ids pass through, a row each. Other columns are not looked at.
    """
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = runtime.pick(pages, "page_id", "url", "html").withColumn("host", host)
    held = "host string, template long, shape long, wrapper binary"

    def tree(w: DataFrame, key: str, by: list[str]) -> DataFrame:
        """One wrapper for each `by`; no task meets all of a large host, as groups are salted by `key` first."""
        for salts in (fan * fan, fan):
            w = w.groupBy(*by, F.pmod(key, F.lit(salts)).alias("salt")).applyInArrow(_aligned, held)
        return w.groupBy(*by).applyInArrow(_aligned, held)

    each = runtime.checkpoint(tree(pages.select("html", "host").mapInArrow(_shapes, held), "shape", ["host", "template"]))
    whole = tree(each.withColumn("shape", F.col("template")), "template", ["host"])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            path = [pickle.dumps(article_path(pickle.loads(w))) for w in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(path, pa.binary())], ["host", "template", "path"])

    def texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [pickle.dumps(constants(pickle.loads(w))) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["host", "constants"])

    paths = each.select("host", "template", "wrapper").mapInArrow(place, "host string, template long, path binary")
    paths = paths.groupBy("host").agg(F.collect_list(F.struct("template", "path")).alias("paths"))
    found = runtime.checkpoint(paths.join(whole.select("host", "wrapper").mapInArrow(texts, "host string, constants binary"), "host"))
    size = found.agg(F.sum(F.length("constants") + F.length("host") + F.aggregate("paths", F.lit(0), lambda n, x: n + 8 + F.length(x["path"])))).first()[0] or 0

    def rows(b: pa.RecordBatch, known: list[tuple | None]) -> pa.RecordBatch:
        texts = [extract(t.as_py(), *k or ({},)) for t, k in zip(b.column(2), known, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    def read_in(paths: list, template: bytes) -> tuple:
        return {t: pickle.loads(p) for t, p in paths}, pickle.loads(template)

    out = "page_id long, url string, text string, n_chars long"
    if size <= SHARED_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: ([tuple(x) for x in r["paths"]], bytes(r["constants"])) for r in found.toLocalIterator()})

        def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {k: read_in(*v) for k, v in shared.value.items()}
            for b in it:
                yield rows(b, [known.get(x) for x in b.column(3).to_pylist()])

        return pages.mapInArrow(read, out)

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, known = None, None
        for b in it:
            found = []
            for x, p, c in zip(b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                if known is None or x != host:
                    host, known = x, read_in([tuple(y.values()) for y in p.as_py()], c.as_py()) if c.is_valid else ({},)
                found.append(known)
            yield rows(b, found)

    return pages.join(found, "host", "left").select("page_id", "url", "html", "host", "paths", "constants").mapInArrow(joined, out)
