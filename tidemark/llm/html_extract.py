"""Main text of web pages: page structure first, then a suffix array per host over the text that structure leaves.

Structure decides where the text is: scripts, menus, forms and the like go, and where most of the text that a page shows lies in its
marked article or main part, that is the text. Other pages leave *open* text. The token streams of a host's
pages are concatenated, marked and open ones apart, and their suffixes sorted up to ``RUN`` tokens. In open text, token runs that start suffixes
of two pages or more are boilerplate, the tokens they cover are removed and the unique runs between them are kept. Marked text is mostly right, and what two
articles share may be a copy, a quotation or a common first line: there, repeated runs count only where they cover whole blocks of a small part of the article that
its template names, the same part on pages that have little else in common (``_known``). Hosts are cut
into chunks of pages; chunks exchange digests of their runs, so a run repeated only across chunks counts as well.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import utf8, windows_hash, word_hashes

#: Tokens of a run that counts as boilerplate when two pages share it. A power of two, as the sorting doubles.
RUN = 16
#: Tokens of a chunk, about.
CHUNK_TOKENS = 2_000_000
#: Bytes of a page for each token, about.
_TOKEN_BYTES = 6
#: Pages with different texts that make a block of a part boilerplate.
PAGES = 3
#: A part of an article is small if the page has so many times its words.
_SMALL = 4

#: Fixed values of the HTML standard: elements without content, elements whose content is raw text, block elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|title"
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
_APART = frozenset("nav footer aside form menu dialog select button label input datalist head".split())
#: Names of page furniture and of reader comments, and what may stand before or behind them in a class, id or role. Such a name is a
#: whole word of the attribute, so that "with-sidebar", "has-share" and "search-results" are none.
_COMMENTS = r"comments?|disqus|replies|respond"
_NAMES = (
    rf"{_COMMENTS}|ads?|advert\w*|banner|breadcrumbs?|consent|contentinfo|cookies?|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notice|popup|promo\w*|related|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget"
)
_BEFORE = r"site|page|main|global|top|bottom|left|right|post|entry|article|primary|secondary|sub|mobile|wp|cookie|nav|skip"
_BEHIND = r"list|section|area|bar|box|block|links?|buttons?|icons?|items?|menu|nav|form|inner|wrap|wrapper|container|widget|text|banner|notice|posts|articles|content|slot|unit|\d+"
_FURNITURE = re.compile(rf"(?:^|(?<=\s))(?:(?:{_BEFORE})[_-]+)*(?:{_NAMES})(?:[_-]+(?:{_BEHIND}|{_NAMES}))*(?=\s|$)", re.IGNORECASE)
_COMMENT = re.compile(rf"(?:{_COMMENTS})", re.IGNORECASE)
#: A part with a furniture name is none when it holds so many times the words that are shown without it.
_MOST = 4
#: Attributes up to the end of a tag. Quotes count behind an equals sign only, and what is not closed reaches to the end of the page.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:svg|math)\b{_ATTRIBUTES}(?<=/)>"
    rf"|<(?P<raw>{_RAW})\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What these hold is text, however many pages have it.
_QUOTED = frozenset("blockquote figure pre table".split())


#: Words, and the part of the article they lie in.
Block = tuple[list[str], str]


def attributes(rest: str) -> dict[str, str]:
    """Values by name in lower case; of equal names the first counts, a slash that ends the tag is no part of a value."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return {k: v.removesuffix("/") for k, v in found.items()} if rest.endswith("/") else found


def _hidden(named: dict[str, str]) -> bool:
    return "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(named.get("style", "")))


def parse(page: str | None) -> tuple[list[str] | None, list[str]]:
    """(words of the marked text or None, words of the open text), both without page furniture.

    The marked text is what lies in ``article`` elements, else in ``main`` or role "main", if that is at least as much as what it leaves
    out; else all that is shown is open text. A header inside either keeps its headings; any other header goes. An element with a furniture name
    that holds the page's largest text is no furniture, unless it is named after comments.
    """
    marked, rest = parse_blocks(page)
    return None if marked is None else _flat(marked), _flat(rest)


def parse_blocks(page: str | None) -> tuple[list[Block] | None, list[Block]]:
    """The texts of ``parse`` as blocks, none of them empty."""
    page = page or ""
    parts, held = _walk(page, frozenset())
    if held:
        shown, largest = len(_flat(_chosen(parts))), max(held.values())
        forgiven = frozenset(at for at, n in held.items() if n > _MOST * shown and 2 * n >= largest)
        if forgiven:
            parts, _ = _walk(page, forgiven)
    n = {where: len(_flat(_chosen(parts, where))) for where in ("article", "both", "main", "open")}
    article = n["article"] + n["both"]
    if article and article >= max(n["main"], n["open"]):
        return _chosen(parts, "article", "both"), []
    if n["main"] and n["main"] + n["both"] >= n["open"] + n["article"]:
        return _chosen(parts, "main", "both"), []
    return None, _chosen(parts)


def _flat(blocks: list[Block]) -> list[str]:
    return [w for words, _ in blocks for w in words]


def _chosen(shown: list[tuple[str, str | None, str]], *places: str) -> list[Block]:
    """Blocks of the text at these places, or of all."""
    found: list[Block] = []
    block, part = [], ""
    for where, piece, named in (*shown, ("", None, "")):
        if piece is not None and (not places or where in places):
            if not block:
                part = named
            block.append(piece)
        elif block:
            words = html.unescape("".join(block)).split()
            if words:
                found.append((words, part))
            block = []
    return found


def _small_parts(blocks: list[Block]) -> str:
    """Number and digest of the part, of each block that lies in a small part of the text."""
    if not any(part for _, part in blocks):
        return ""
    n: dict[str, int] = {}
    for words, part in blocks:
        n[part] = n.get(part, 0) + len(words)
    total = sum(n.values())
    return " ".join(f"{i}:{_signed(xxhash.xxh3_64_intdigest(part))}" for i, (_, part) in enumerate(blocks) if part and _SMALL * n[part] <= total)


def _walk(page: str, forgiven: frozenset[int]) -> tuple[list[tuple[str, str | None, str]], dict[int, int]]:
    """(text shown, None where a block starts or ends, with its place: open, main, article or both, and its part; words of each element hidden only for its name or those around it).

    Elements are named by where they start; those of ``forgiven`` are not hidden for their name. The part is the path of block elements inside the article or main
    part from the first one with a class, id or role on; empty if there is none, and inside quotations, figures, tables and preformatted text.
    """
    parts: list[tuple[str, str | None, str]] = []
    held: dict[int, int] = {}
    # Name, does its text count, where it belongs, furniture around it, is it hidden for another reason, its part (None: it has none).
    stack: list[tuple[str, bool, str, tuple[int, ...], bool, str | None]] = []
    counts, where, veils, hard, part, last = True, "open", (), False, "", 0

    def text(piece: str) -> None:
        if counts:
            parts.append((where, piece, part or ""))
        elif veils and not hard:
            n = len(piece.split())
            for at in veils:
                held[at] = held.get(at, 0) + n

    for token in _TOKEN.finditer(page):
        if token.start() > last:
            text(page[last : token.start()])
        last = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if counts and name in _BLOCK:
            parts.append((where, None, ""))
        if token["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    _, counts, where, veils, hard, part = stack[depth]
                    del stack[depth:]
                    break
            if counts and name in _BLOCK:
                parts.append((where, None, ""))
            continue
        if name in _VOID:
            continue
        stack.append((name, counts, where, veils, hard, part))
        given = attributes(token["rest"]) if token["rest"] else {}
        named = " ".join(given[k] for k in ("class", "id", "role") if given.get(k))
        furniture = _FURNITURE.search(named) if named and name not in ("body", "html") and token.start() not in forgiven else None
        if name in _QUOTED:
            part = None
        elif part is not None and where != "open" and name in _BLOCK and (part or named):
            # Numbers differ from page to page.
            part = f"{part}/{name}.{re.sub(r'[0-9]+', '', named).strip().lower()}"
        if name in _APART or _hidden(given) or (furniture and _COMMENT.search(furniture[0])):
            counts, hard = False, True
        elif furniture:
            counts, veils = False, (*veils, token.start())
        elif name == "header":
            counts, hard = False, True
        elif name in _HEADINGS and where != "open" and any(n == "header" for n, *_ in stack) and all(
            n == "header" or shown for n, shown, *_ in _inner(stack)
        ):
            counts = True
        elif counts and name == "article":
            where, part = "both" if where in ("main", "both") else "article", ""
        elif counts and where == "open" and (name == "main" or given.get("role", "").strip().lower() == "main"):
            where, part = "main", ""
    if last < len(page):
        text(page[last:])
    return parts, held


def _inner(stack: list[tuple]) -> list[tuple]:
    """The open elements up to and with the header; what a heading in a header needs to have been shown."""
    at = max(k for k, (n, *_) in enumerate(stack) if n == "header")
    return stack[: at + 1]


def host_of(url: str | None) -> str:
    """Host name in lower case, without ``www.`` and ``m.``; empty when there is none."""
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        return ""
    return re.sub(r"^(?:www|m)\.", "", host)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words are joined by spaces, blocks of marked text by line feeds; words hold neither. A page without words counts as marked."""
    for batch in batches:
        found = [parse_blocks(h) for h in batch.pop("html")]
        batch["host"] = [host_of(u) for u in batch["url"]]
        batch["marked"] = [marked is not None or not rest for marked, rest in found]
        batch["text"] = [" ".join(_flat(rest)) if marked is None else "\n".join([" ".join(words) for words, _ in marked]) for marked, rest in found]
        batch["parts"] = [_small_parts(marked or []) for marked, _ in found]
        yield batch


def run_classes(tokens: np.ndarray, run: int) -> np.ndarray:
    """Sort all suffixes by their first ``run`` tokens, by doubling; equal numbers mean equal runs.

    ``tokens`` are numbers from 0; a run that reaches past the end is no run of this length and gets -1.
    """
    rank, reach = tokens.astype(np.int64), 1
    while reach < run:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: max(0, len(rank) - reach)] = rank[reach:]
        _, rank = np.unique(rank * (len(rank) + 1 + tokens.max()) + ahead + 1, return_inverse=True)
        reach *= 2
    rank = rank.copy()
    rank[max(0, len(rank) - run + 1) :] = -1
    return rank


class _Streams:
    """The concatenated token streams of the pages of a chunk, and the runs that stay inside a page."""

    def __init__(self, pages: pd.DataFrame):
        self.pages = pages
        vocabulary: dict[str, int] = {}
        numbers = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _tokens(t)], np.int64) for t in pages["text"]]
        counts = np.array([len(n) for n in numbers], np.int64)
        self.tokens = tokens = np.concatenate(numbers)
        del numbers
        self.vocabulary = vocabulary
        self.page = np.repeat(np.arange(len(counts)), counts)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.rank = run_classes(tokens, RUN) if len(tokens) else tokens
        end = np.minimum(np.arange(len(tokens)) + RUN - 1, len(tokens) - 1)
        self.rank[self.page[end] != self.page] = -1
        self.at = np.flatnonzero(self.rank >= 0)

    @cached_property
    def hashes(self) -> np.ndarray:
        """Of the words, by token."""
        return word_hashes([utf8(w) for w in self.vocabulary])

    @cached_property
    def names(self) -> np.ndarray:
        """Digests of the runs at ``at``."""
        return windows_hash(self.hashes[self.tokens], RUN)[self.at].view(np.int64)

    def covered(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """Which tokens lie in these pieces."""
        edge = np.zeros(len(self.page) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes, -1)
        return np.cumsum(edge)[:-1] > 0

    def repeated(self) -> np.ndarray:
        """Which suffixes start with a run that another page of the chunk has."""
        out = np.zeros(len(self.page), bool)
        if len(self.at):
            of, key = self.rank[self.at], self.pages["key"].to_numpy()[self.page[self.at]]
            low, high = np.full(of.max() + 1, np.iinfo(np.int64).max), np.full(of.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, of, key)
            np.maximum.at(high, of, key)
            out[self.at] = (low < high)[of]
        return out


def _tokens(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ") if text else []


_EVIDENCE = "host string, marked boolean, chunk int, run long, place long, low long, high long, start int, size int, context long, copy long, own boolean"


def _evidence(pages: pd.DataFrame) -> pd.DataFrame:
    """Runs of open pages; of marked ones, pieces of ``RUN`` tokens or more that start or end with a block of a small part."""
    names = [c.split()[0] for c in _EVIDENCE.split(", ")]
    if pages["chunks"].iloc[0] == 1 and pages["key"].nunique() == 1:
        return pd.DataFrame(columns=names, dtype=object)
    streams = _Streams(pages)
    if pages["marked"].iloc[0]:
        out = pd.DataFrame(list(_pieces(streams)), columns=names[3:])
    else:
        key = pages["key"].to_numpy()[streams.page[streams.at]]
        out = pd.DataFrame({"run": streams.names, "key": key}).groupby("run")["key"].agg(["min", "max"])
        out = out.reset_index().rename(columns={"min": "low", "max": "high"}).assign(place=0, start=0, size=0, context=0, copy=0, own=False)
    return out.assign(**{c: pages[c].iloc[0] for c in names[:3]})[names]


def _pieces(streams: _Streams) -> Iterator[tuple]:
    """(digest, place, key, key, start and size in tokens, context, copy, own) of every such piece.

    The place is the digest of the part. The context of a page is the least hash of its
    three-token windows, which copies of an article with few changes mostly share; ``copy`` is the digest of the whole text. A page is its
    own if runs of other pages of the chunk cover at most half of it. A host of one chunk needs no pieces that the chunk does not repeat.
    """
    if not streams.pages["parts"].any():
        return
    repeated = streams.repeated()
    covered = streams.covered(np.flatnonzero(repeated), RUN)
    alone = streams.pages["chunks"].iloc[0] == 1
    pages = streams.pages
    for text, parts, key, first, last in zip(pages["text"], pages["parts"], pages["key"].tolist(), streams.starts.tolist(), streams.ends.tolist()):
        n, pieces = last - first, []
        if n < RUN or not parts:
            continue
        ends = np.cumsum([len(_tokens(block)) for block in text.split("\n")]).tolist()
        for i, place in _numbered(parts).items():
            start, end = ends[i - 1] if i else 0, ends[i]
            reach = max(end, start + RUN)
            if reach <= n:
                pieces.append((start, reach, place))
            if reach > end >= RUN:
                pieces.append((end - RUN, end, place))
        pieces = [p for p in pieces if repeated[first + p[0]] or not alone]
        if not pieces:
            continue
        hashes = streams.hashes[streams.tokens[first:last]]
        context, copy = _signed(windows_hash(hashes, 3).min()), _digest(hashes)
        own = 2 * int(covered[first:last].sum()) <= n
        for start, reach, place in pieces:
            yield _digest(hashes[start:reach]), place, key, key, start, reach - start, context, copy, own


def _numbered(parts: str) -> dict[int, int]:
    return {int(i): int(place) for i, place in (p.split(":") for p in parts.split())}


def _signed(digest: int) -> int:
    return int(np.uint64(digest).view(np.int64))


def _digest(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))


def _known(evidence: DataFrame) -> DataFrame:
    """(host, run, place) of boilerplate: of open text, runs of two pages; of marked text, pieces that ``PAGES`` own pages with different contexts have in one place,
    if at least half of the different texts that have the piece there differ in context as well, as those of copied articles do not."""
    texts = evidence.groupBy("host", "run", "place", "copy").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("context").alias("context"), F.max("own").alias("own")
    )
    places = texts.groupBy("host", "run", "place").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("texts"), F.expr("count(DISTINCT if(own, context, NULL)) AS contexts")
    )
    return places.where(f"if(place = 0, low <> high, contexts >= {PAGES} AND 2 * contexts >= texts)").select("host", "run", "place")


def _cleaned(pages: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    if not len(pages):
        return pd.DataFrame({"page_id": [], "url": [], "text": []})
    if not len(known):
        text = [t.replace("\n", " ") for t in pages["text"]]
    elif not pages["marked"].iloc[0]:
        streams = _Streams(pages)
        covered = streams.covered(streams.at[np.isin(streams.names, known["run"].to_numpy())], RUN)
        text = [
            " ".join([w for w, gone in zip(_tokens(text), covered[start:end].tolist()) if not gone])
            for text, start, end in zip(pages["text"], streams.starts, streams.ends)
        ]
    else:
        cuts = {key: set(zip(rows["start"].tolist(), rows["size"].tolist())) for key, rows in known.groupby("low")}
        text = [_without(t, parts, cuts.get(key, ())) for t, parts, key in zip(pages["text"], pages["parts"], pages["key"].tolist())]
    return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "text": text})


def _without(text: str, parts: str, cuts: Iterable[tuple[int, int]]) -> str:
    """The text without the blocks of small parts that the cuts cover."""
    gone, small, end = {at for start, size in cuts for at in range(start, start + size)}, _numbered(parts), 0
    kept = []
    for i, block in enumerate(text.split("\n")):
        start, end = end, end + len(_tokens(block))
        if i not in small or not gone.issuperset(range(start, end)):
            kept.append(block)
    return " ".join(kept)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id_col``, ``url_col``, text (words joined by one space; empty when there are none).

    Null and empty pages have an empty text. A null or malformed url belongs to the nameless host. Rows that repeat
    an id are pages of their own, but rows with the same url and html are one page to the search for
    boilerplate. Other columns are not looked at.
    """
    pages = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    id_type = dict(pages.dtypes)["page_id"]
    host = F.pandas_udf(lambda urls: urls.map(host_of), "string")
    sizes = pages.select(host("url").alias("host"), F.octet_length("html").alias("n")).groupBy("host").agg(F.sum("n").alias("n"))
    # Hosts of several chunks; each fills one at least, so they are few.
    chunk = CHUNK_TOKENS * _TOKEN_BYTES
    large = sizes.where(f"n > {chunk}").selectExpr("host", f"cast(ceil(n / {chunk}) AS int) AS chunks")
    # A number of its own for every row of a page, so that many copies of one page are dealt to all chunks.
    keyed = pages.select("*", F.xxhash64("url", "html").alias("key"), F.xxhash64("page_id", "url", "html").alias("deal"))
    parsed = keyed.mapInPandas(_parsed, f"page_id {id_type}, url string, key long, deal long, host string, marked boolean, text string, parts string")
    streams = parsed.join(F.broadcast(large), "host", "left").selectExpr(
        "page_id", "url", "key", "host", "marked", "text", "parts", "coalesce(chunks, 1) AS chunks", "cast(pmod(deal, coalesce(chunks, 1)) AS int) AS chunk"
    )
    # One shuffle of the texts, which all steps read.
    streams = streams.groupBy("host", "marked", "chunk")
    evidence = streams.applyInPandas(_evidence, _EVIDENCE)
    found = evidence.join(_known(evidence), ["host", "run", "place"]).groupBy("host", "marked", "chunk")
    cleaned = streams.cogroup(found).applyInPandas(_cleaned, f"page_id {id_type}, url string, text string")
    return cleaned.withColumnsRenamed({"page_id": id_col, "url": url_col})
