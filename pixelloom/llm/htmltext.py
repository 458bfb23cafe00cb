"""Main text of web pages by template deduction over equivalence classes.

A page's tokens are its structural elements, told apart by the elements around them and, for those that hold others, by
their turn among siblings of one kind, and the words of its text, told apart by the element they stand in. Names that a
site gives to classes or ids play no part. For every host, each token has an occurrence vector over all pages of the host:
how often each page holds it. Tokens with one vector form an equivalence class. A class is valid if at least SUPPORT of the host's pages, and LEAST_PAGES,
hold it; it has an element or LARGE words; its members follow each other in one order, the same on all pages; no run of it straddles a member of
a valid class with more pages; and the elements around its members lie in valid classes. A class that is out of order holds
tokens of several roles that only happen to be as frequent, such as a menu's items beside as many paragraphs: it is split by the
element around its members, and the parts are held to the same rules. Of a part that is out of order still, elements stand
alone and words belong to no class. The valid classes nest into the host's template.

Elements of the template that stand once in each of their pages cut a page into slots. The slot of the article is the deepest
one that holds MOST of the host's free text, which is what is neither in links nor in words of the template. Slots nested in
it that hold less than PART of its free text are menus, adverts, notices, footers and the like, and are left out. So are
blocks made of nothing but the template's words, but not in a slot that is an article or main as a whole, and not where they
are most of a page's text, as in copies of one page. Of an element that is not the template's, HTML's own meaning decides: nav, aside, form, menu, dialog, and the header and footer of
a whole page are left out.

Hosts of fewer than LEAST_PAGES pages share the template of all such hosts' elements. A page without a slot is judged alone,
by the meaning of its elements: its longest article or main, or else all of it. Of equally rich slots the deepest is taken,
of equally deep ones the one with the smallest token.

Vectors are compared by two 32-bit hashes over (page, count), summed over pages, so that they aggregate before the shuffle and
repeated pages count; tokens are 64-bit hashes. Orders are checked on each page's sequence of tokens, reduced to what a bit field of
fixed size holds of all hosts' candidates. A host's template is small and joins its pages.

Pages are read in linear time, however long, deep or broken: an unfinished tag ends at the page's end, a quote that is never
closed is an ordinary character, and of unclosed elements only raw text (scripts, styles, titles, text areas) takes the rest.
Character references are decoded; white space inside a block becomes one space; blocks are joined by one newline. A null
or empty html gives an empty text; a page without a URL belongs to the host ''. Repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

SUPPORT = 0.5
#: Words of a class without elements, and pages of a host, from which on chance does not make them.
LARGE, LEAST_PAGES = 3, 3
#: Bits of the field that tells which words may be candidates; more candidates only let more words through.
FIELD = 1 << 22
#: Share of the host's free text that the article's slot holds, and share of the slot's that a slot nested in it needs to stay.
MOST, PART = 0.6, 0.2

# Element names of HTML by the part they play.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea".split())
_UNSEEN = _RAW | frozenset("noscript template select button svg math iframe object canvas".split())
_ASIDE = frozenset("nav aside form menu dialog".split())
_HOLDERS = frozenset("html body div section main article td center header footer".split()) | _ASIDE
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|[!?])")
_MARK = re.compile(r"""[>"']""")
_SPACE = re.compile(r"\s+")


class Paths:
    """Elements by their place, numbered as they are met; an element's parent has a smaller number. Number 0 is the page."""

    def __init__(self):
        self.number: dict[tuple[int, str, int], int] = {}
        self.parent, self.tag, self.code, self.depth = [0], [""], [0], [0]
        # within article, main or section; how many elements around, itself included, are asides, and headers or footers of the page
        self.in_section, self.asides, self.edges = [False], [0], [0]

    def child(self, parent: int, tag: str, turn: int) -> int:
        key = (parent, tag, turn)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.code)
            self.parent.append(parent)
            self.tag.append(tag)
            self.depth.append(self.depth[parent] + 1)
            section = self.in_section[parent]
            self.in_section.append(section or tag in ("article", "main", "section"))
            self.asides.append(self.asides[parent] + (tag in _ASIDE))
            self.edges.append(self.edges[parent] + (tag in ("header", "footer") and not section))
            digest = hashlib.blake2b(f"{self.code[parent]} {tag} {turn}".encode(), digest_size=8).digest()
            self.code.append(int.from_bytes(digest, "little", signed=True))
        return n


def _tag_end(page: str, at: int, dead: set[str]) -> int:
    """Place of the > that ends a tag, outside of quoted values; -1 if there is none. dead: what need not be looked for again."""
    end = page.find(">", at)
    if end < 0 or "=" in dead or (page.find('"', at, end) < 0 and page.find("'", at, end) < 0):
        return end
    pos = at
    while m := _MARK.search(page, pos):
        before, c, start, pos = pos, m[0], m.start(), m.end()
        if c == ">":
            return start
        if c not in dead and page[before:start].rstrip()[-1:] == "=":  # what stands between two marks is looked at once
            close = page.find(c, pos)
            if close < 0:
                dead.add(c)
            else:
                pos = close + 1
    dead.add("=")  # quotes swallowed all that is left: from here on they are ordinary characters
    return end


def nodes(page: str, paths: Paths) -> list[tuple[int, int, str, bool]]:
    """(path, block, text, in a link) of every text, and (path, block, '', False) where an element begins, in page order."""
    out: list[tuple[int, int, str, bool]] = []
    stack: list[tuple[int, str, dict[str, int]]] = []
    opened: dict[str, int] = {}
    top: dict[str, int] = {}
    here, turns = 0, top
    block = at = 0
    link = False
    dead: set[str] = set()
    child, search, size = paths.child, _OPEN.search, len(page)

    def close(keep: int) -> None:
        nonlocal here, turns
        while len(stack) > keep:
            opened[stack.pop()[1]] -= 1
        here, turns = (stack[-1][0], stack[-1][2]) if stack else (0, top)

    while m := search(page, at):
        start = m.start()
        if start > at:
            out.append((here, block, page[at:start], link))
        tag = m[2]
        if tag is None:
            end = page.find("-->", start + 4) if m[0] == "<!--" else page.find(">", start)
            at = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        at = m.end()
        end = at if page[at : at + 1] == ">" else _tag_end(page, at, dead)
        if end < 0:
            at = size
            break
        at, tag, closing = end + 1, tag.lower(), m[1] == "/"
        if tag == "br":
            out.append((here, block, " ", False))
        elif tag in _VOID:
            block += tag == "hr"
        elif tag in _INLINE:
            if tag == "a":
                link = not closing
        elif tag in _UNSEEN:
            if not closing and page[end - 1] != "/" and tag not in dead:
                finish = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if finish:
                    at = finish.end()
                elif tag in _RAW:
                    at = size
                else:
                    dead.add(tag)
        elif closing:
            block += 1
            if opened.get(tag):
                link = False
                k = len(stack) - 1
                while stack[k][1] != tag:
                    k -= 1
                close(k)
        else:
            block += 1
            link = False
            if stack and stack[-1][1] == "p":
                close(len(stack) - 1)
            if (ends := _CLOSED_BY.get(tag)) and any(opened.get(e) for e in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1] in _LISTS:
                        break
                    if stack[k][1] in ends:
                        close(k)
                        break
            turn = 0
            if tag in _HOLDERS:
                turn = turns[tag] = turns.get(tag, 0) + 1
            here, turns = child(here, tag, turn), {}
            stack.append((here, tag, turns))
            opened[tag] = opened.get(tag, 0) + 1
            out.append((here, block, "", False))
    if at < size:
        out.append((here, block, page[at:], link))
    return out


def hashed(values: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(values, object), categorize=False).view(np.int64) if values else np.zeros(0, np.int64)


def word_tokens(path: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Tokens of words (hashes) at paths (hashes)."""
    return C.mix(word.view(C.U64) * C.U64(0x9E3779B97F4A7C15) + path.view(C.U64)).view(np.int64)


# ---------------------------------------------------------------- deduction for one host
Key = tuple[int, int, int]


def _class_key(r: dict) -> Key:
    return r["pages"], r["times"], r["vector"]


def _sized(v: list[dict]) -> bool:
    return len(v) >= LARGE or any(r["tag"] is not None for r in v)


def by_role(members: list[dict]) -> dict[int, list[dict]]:
    """A class's members by the element around them, in order of that element."""
    out: dict[int, list[dict]] = {}
    for r in sorted(members, key=lambda r: (r["at"], r["token"])):
        out.setdefault(r["at"], []).append(r)
    return out


def valid_classes(rows: list[dict], pages: int, bad: frozenset[Key] = frozenset(), worse: frozenset[tuple[Key, int]] = frozenset()) -> list[list[dict]]:
    """The classes of a host's tokens that are valid. rows: token, at (the element around it), tag (None: a word), pages,
    times, vector, chars, links; bad: classes out of order, which are split by the element around their members; worse: parts of
    those, by that element, that are out of order still, whose elements stand alone and whose words belong to no class."""
    classes: dict[Key, list[dict]] = {}
    for r in rows:
        classes.setdefault(_class_key(r), []).append(r)
    valid = []
    for k, v in classes.items():
        if k[0] < max(SUPPORT * pages, min(LEAST_PAGES, pages)):
            continue
        parts = [(None, v)] if k not in bad else list(by_role(v).items())
        for at, part in parts:
            if (k, at) in worse:
                valid += [[r] for r in part if r["tag"] is not None]
            elif _sized(part):
                valid.append(part)
    count = -1
    while len(valid) != count:  # a class stands only if all of its members are nested in what stands
        count = len(valid)
        template = {0, *(r["token"] for v in valid for r in v if r["tag"] is not None)}
        valid = [v for v in valid if all(r["at"] in template for r in v)]
    return valid


def template(rows: list[dict], bad: frozenset[Key] = frozenset(), worse: frozenset[tuple[Key, int]] = frozenset()) -> tuple[int | None, list[int], list[int]]:
    """(slot of the article, slots in it that are left out, words of the template) of a host; see valid_classes."""
    whole = next(r for r in rows if r["token"] == 0)
    held = [r for v in valid_classes([r for r in rows if r["token"] != 0], whole["pages"], bad, worse) for r in v]
    above = {r["token"]: r["at"] for r in held if r["tag"] is not None}
    once = {r["token"]: r for r in held if r["tag"] in _HOLDERS and r["pages"] == r["times"]}
    free = {t: r["chars"] - r["links"] for t, r in once.items()}
    words = [r for r in held if r["tag"] is None]
    for r in words:
        at = r["at"]
        while at:
            if at in free:
                free[at] -= r["chars"] - r["links"]
            at = above[at]

    def depth(t: int) -> int:
        n = 0
        while t:
            t, n = above[t], n + 1
        return n

    body = max(free.values(), default=0)
    rich = [t for t in once if body > 0 and free[t] >= MOST * body and once[t]["tag"] not in _ASIDE]
    if not rich:
        return None, [], []
    slot = max(rich, key=lambda t: (depth(t), -t))
    out = []
    for t, r in once.items():
        at = above[t]
        while at and at != slot:
            at = above[at]
        of_article = r["tag"] == "header" and once[slot]["tag"] not in ("html", "body")  # an article's own heading
        if at == slot and not of_article and free[t] < PART * free[slot]:
            out.append(t)
    marked = once[slot]["tag"] in ("article", "main")  # all of it is the article's
    return slot, sorted(out), [] if marked else sorted(r["token"] for r in words)


# ---------------------------------------------------------------- one page
def _alone(own: list[tuple[int, int, str, bool]], paths: Paths) -> int:
    """The longest article or main of a page, or 0 for all of it."""
    sizes = [0] * len(paths.code)
    for path, _, text, _ in own:
        sizes[path] += len(text)
    for n in range(len(sizes) - 1, 0, -1):
        sizes[paths.parent[n]] += sizes[n]
    return max((n for n in range(1, len(sizes)) if paths.tag[n] in ("article", "main")), key=lambda n: (sizes[n], -n), default=0)


Template = tuple[int | None, frozenset[int], frozenset[int]]
NONE: Template = (None, frozenset(), frozenset())


def main_text(page: str, host: Template = NONE, spare: Template = NONE) -> str:
    """The article of a page, given the template (slot, slots left out, words) of its host and the one that small hosts share."""
    paths = Paths()
    own = nodes(page, paths)
    place = {c: n for n, c in enumerate(paths.code)}
    slot, out, words = next((t for t in (host, spare) if t[0] in place), NONE)
    root = place[slot] if slot is not None else _alone(own, paths)
    whole = paths.tag[root] in ("", "html", "body")
    inside = {0: root == 0, root: True} | {place[c]: False for c in out if c in place}
    blocks: dict[int, list[str]] = {}
    fresh: set[int] = set()
    for path, block, text, _ in own:
        if not text or paths.asides[path] > paths.asides[root] or (whole and paths.edges[path]):
            continue
        n, chain = path, []
        while n not in inside:
            chain.append(n)
            n = paths.parent[n]
        for c in chain:
            inside[c] = inside[n]
        if inside[path]:
            blocks.setdefault(block, []).append(text)
            if words and block not in fresh and (mine := text.split()):
                if not words.issuperset(word_tokens(np.full(len(mine), paths.code[path]), hashed(mine)).tolist()):
                    fresh.add(block)
    lines = {k: _SPACE.sub(" ", entities.unescape("".join(b))).strip() for k, b in blocks.items()}
    if words:
        kept = {k: x for k, x in lines.items() if k in fresh}
        if 2 * sum(map(len, kept.values())) >= sum(map(len, lines.values())):
            lines = kept
    return "\n".join(x for x in lines.values() if x)


# ---------------------------------------------------------------- Spark
def _sequences(pages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Paths]:
    """(page, path, token, characters, in links, is a word) of all tokens in page order; an element's characters are 0 here."""
    paths = Paths()
    texts: list[str] = []
    rows: list[tuple[int, int, int, bool]] = []  # page, path, words (0: an element), in a link
    for i, page in enumerate(pages):
        for path, _, text, link in nodes(page, paths):
            if not text:
                rows.append((i, path, 0, False))
            elif got := text.split():
                texts += got
                rows.append((i, path, len(got), link))
    node = np.array(rows, np.int64).reshape(-1, 4)
    page, path, many, link = (np.repeat(node[:, k], np.maximum(node[:, 2], 1)) for k in range(4))
    is_word, token, size = many > 0, np.array(paths.code, np.int64)[path], np.zeros(len(path), np.int64)
    token[is_word] = word_tokens(token[is_word], hashed(texts))
    size[is_word] = np.fromiter(map(len, texts), np.int64, len(texts))
    return page, path, token, size, size * link, is_word, paths


def _sums(first: list[np.ndarray], values: list[np.ndarray], how: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """values reduced by equal rows of the keys first."""
    order = np.lexsort(first[::-1])
    first = [k[order] for k in first]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in first])
    at = np.flatnonzero(new)
    return [k[at] for k in first], [f.reduceat(v[order], at) for f, v in zip(how, values, strict=True)] if len(at) else values


def _elements(page: np.ndarray, path: np.ndarray, size: np.ndarray, link: np.ndarray, is_word: np.ndarray, paths: Paths, pages: int) -> tuple[np.ndarray, ...]:
    """(page, path, times, characters below, in links below) of every element of every page, the page itself included."""
    wide = len(paths.code)
    start = np.arange(pages) * wide
    key, times = np.unique(np.concatenate([start, page[~is_word] * wide + path[~is_word]]), return_counts=True)
    chars, links = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    at = np.searchsorted(key, page[is_word] * wide + path[is_word])
    np.add.at(chars, at, size[is_word])
    np.add.at(links, at, link[is_word])
    own_page, own_path = key // wide, key % wide
    parent, depth = np.array(paths.parent), np.array(paths.depth)[own_path]
    up = np.searchsorted(key, own_page * wide + parent[own_path])
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    for d in range(len(cuts) - 2, 0, -1):
        these = order[cuts[d] : cuts[d + 1]]
        np.add.at(chars, up[these], chars[these])
        np.add.at(links, up[these], links[these])
    return own_page, own_path, times, chars, links


_SLICE = 256
_SEEN = "host string, token long, at long, tag string, pages long, times long, one long, two long, chars long, links long"
_ADD = [np.maximum, np.maximum, np.add, np.add, np.add, np.add, np.add, np.add]


def _often_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of the words that SUPPORT of a host's pages in the batch hold: what so many of all its pages hold is among
    them in one batch at least."""
    for batch in batches:
        code, parts = hashed(batch.column(0).to_pylist()), []
        for k in range(0, len(code), _SLICE):
            page, _, token, _, _, is_word, _ = _sequences(batch.column(1).slice(k, _SLICE).to_pylist())
            one = np.ones(int(is_word.sum()), np.int64)
            (page, token), _ = _sums([page[is_word], token[is_word]], [one], [np.add])
            parts.append(_sums([code[k:][page], token], [np.ones(len(page), np.int64)], [np.add]))
        host, token, n = (np.concatenate(c) for c in zip(*((*k, *v) for k, v in parts), strict=True)) if parts else [np.zeros(0, np.int64)] * 3
        (host, token), (n,) = _sums([host, token], [n], [np.add])
        known, many = np.unique(code, return_counts=True)
        pick = n >= SUPPORT * many[np.searchsorted(known, host)]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_field_bits(host[pick], token[pick])))], ["b"])


def _field(bits: DataFrame) -> bytes:
    """A field with the bits (b); at most FIELD / 8 rows come to the driver at any size."""
    field = np.zeros(FIELD // 8, np.uint8)
    for r in bits.groupBy(F.shiftright("b", 3).alias("i")).agg(F.bit_or(F.expr("shiftleft(1, cast(b & 7 as int))")).alias("v")).toLocalIterator():
        field[r.i] = r.v
    return field.tobytes()


def _bits(field) -> np.ndarray:
    return np.unpackbits(np.frombuffer(field.value, np.uint8), bitorder="little").astype(bool)


def _occurrences(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of each host, words if in the field, summed over a batch."""
        have = _bits(field)
        for batch in batches:
            hosts, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            number = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
            own, host_code = np.array([number[h] for h in hosts], np.int64), hashed(hosts)
            tags: dict[str, int] = {"": 0}
            parts: list[list[np.ndarray]] = []
            for k in range(0, len(hosts), _SLICE):
                texts = batch.column(2).slice(k, _SLICE).to_pylist()
                page, path, token, size, link, is_word, paths = _sequences(texts)
                codes, kinds = np.array(paths.code), np.array([tags.setdefault(t, len(tags)) for t in paths.tag])
                at, row, times, chars, links = _elements(page, path, size, link, is_word, paths, len(texts))
                rows = [own[k:][at], codes[row], codes[np.array(paths.parent)[row]], kinds[row], np.ones(len(at), np.int64), times, *_vector(ids[k:][at], times), chars, links]
                pick = is_word.copy()
                pick[is_word] = have[_field_bits(host_code[k:][page[is_word]], token[is_word])]
                (page, token), (times, at, size, link) = _sums([page[pick], token[pick]], [np.ones(int(pick.sum()), np.int64), codes[path[pick]], size[pick], link[pick]], [np.add, np.maximum, np.add, np.add])
                one = np.ones(len(page), np.int64)
                more = [own[k:][page], token, at, -one, one, times, *_vector(ids[k:][page], times), size, link]
                keys, values = _sums([np.concatenate([a, b]) for a, b in zip(rows[:2], more[:2], strict=True)], [np.concatenate([a, b]) for a, b in zip(rows[2:], more[2:], strict=True)], _ADD)
                parts.append([*keys, *values])
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                (host, token), (at, kind, *sums) = _sums(cols[:2], cols[2:], _ADD)
                tag = pa.array(list(tags), pa.string()).take(pa.array(np.where(kind < 0, 0, kind), mask=kind < 0))
                yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()).take(pa.array(host)), pa.array(token), pa.array(at), tag, *map(pa.array, sums)], ["host", "token", "at", "tag", "pages", "times", "one", "two", "chars", "links"])

    return run


def _vector(page: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 32 bits of (page, count), whose sums over pages stand for the vector; a repeated page counts again."""
    x = C.mix(page.view(C.U64) * C.U64(0xD6E8FEB86659FD93) + times.astype(np.int64).view(C.U64))
    return (x >> C.U64(32)).view(np.int64), (x & C.U64(0xFFFFFFFF)).view(np.int64)


def _field_bits(host: np.ndarray, token: np.ndarray) -> np.ndarray:
    return (C.mix(host.view(C.U64) * C.U64(0x9E3779B97F4A7C15) + token.view(C.U64)) % C.U64(FIELD)).astype(np.int64)


def _large(rows: list[dict]) -> list[tuple[Key, list[dict]]]:
    """Classes that are large enough to be a template's, with their members; those with more pages come first."""
    out: dict[Key, list[dict]] = {}
    for r in rows:
        if r["token"] != 0:
            out.setdefault(_class_key(r), []).append(r)
    return sorted(((k, v) for k, v in out.items() if _sized(v)), key=lambda x: (-x[0][0], x[0]))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, sorted tokens, the number of each one's class and of its role in it, bits in the field)."""
    for batch in batches:
        toks, nums, roles, bits = [], [], [], []
        for host, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = sorted((r["token"], i, j) for i, (_, v) in enumerate(_large(rows)) for j, part in enumerate(by_role(v).values()) for r in part)
            for col, k in ((toks, 0), (nums, 1), (roles, 2)):
                col.append([x[k] for x in found])
            bits.append(np.unique(_field_bits(np.repeat(hashed([host]), len(found)), np.array(toks[-1], np.int64))).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in (toks, nums, roles, bits))], ["host", "tokens", "numbers", "roles", "bits"])


def _reduced(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different (host, sequence of what may be candidates) of a batch."""
        have = _bits(field)
        for batch in batches:
            hosts, seen = batch.column(0).to_pylist(), set()
            for k in range(0, len(hosts), _SLICE):
                page, _, token, *_ = _sequences(batch.column(2).slice(k, _SLICE).to_pylist())
                code = hashed(hosts[k : k + _SLICE])
                pick = have[_field_bits(code[page], token)]
                page, token = page[pick], token[pick]
                ends = np.searchsorted(page, np.arange(len(code) + 1))
                seen |= {(hosts[k + i], token[ends[i] : ends[i + 1]].tobytes()) for i in range(len(code))}
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([np.frombuffer(x, np.int64) for _, x in seen], pa.list_(pa.int64()))], ["host", "sequence"])

    return run


def _ordered(token: np.ndarray, at: np.ndarray, valid: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray | None, int]:
    """(one run of the members at these places, its length), or None if they are out of order or straddle a valid class."""
    mine = token[at]
    size = len(np.unique(mine))
    runs = mine.reshape(-1, size) if len(mine) % size == 0 else None
    if runs is None or not (runs == runs[0]).all() or len(np.unique(runs[0])) != size:
        return None, size
    begin, end = at[::size], at[size - 1 :: size]
    for other, width in valid:  # whole runs of one class lie in one gap of the other
        a, b = np.searchsorted(other, begin), np.searchsorted(other, end)
        inside = b - a
        if (inside % width).any() or (a[inside > 0] % width).any():
            return None, size
        if (inside > 0).any():  # the other's runs within this one must not be cut by its members
            x, y = np.searchsorted(at, other[::width]), np.searchsorted(at, other[width - 1 :: width])
            if ((y - x) % size).any() or (x[y > x] % size).any():
                return None, size
    return runs[0], size


def _order_code(run: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(np.ascontiguousarray(run).tobytes(), digest_size=8).digest(), "little", signed=True)


def class_orders(token: np.ndarray, number: np.ndarray, role: np.ndarray | None = None, known: set | None = None) -> dict[tuple[int, int], tuple[int, bool]]:
    """(class number, -1) -> (hash of its members' order, well-formed) of a page's candidates in page order; and the same for
    (class number, role), the parts that a class is split into if it is out of order anywhere. Parts of a class in order are
    those of its run: known holds the (class, order) for which they need not be told again."""
    out: dict[tuple[int, int], tuple[int, bool]] = {}
    valid: list[tuple[np.ndarray, int]] = []
    for c in np.unique(number).tolist():
        at = np.flatnonzero(number == c)
        run, size = _ordered(token, at, valid)
        out[c, -1] = (0, False) if run is None else (_order_code(run), True)
        if role is not None and (run is None or known is None or (c, out[c, -1][0]) not in known):
            of = role[at] if run is None else role[at][:size]
            for j in np.unique(of).tolist():
                part, wide = _ordered(token, at[of == j], valid) if run is None else (run[of == j], 0)
                out[c, j] = (0, False) if part is None else (_order_code(part), True)
                if run is None and part is not None:
                    valid.append((at[of == j], wide))
        if run is not None:
            valid.append((at, size))
            if known is not None:
                known.add((c, out[c, -1][0]))
    return out


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, int, int], list] = {}
        known: dict[str, set] = {}
        for host, seq, tok, num, role in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3, 4)), strict=True):
            seq, tok, num, role = (x.values.to_numpy(zero_copy_only=False) for x in (seq, tok, num, role))
            if len(tok):
                at = np.minimum(np.searchsorted(tok, seq), len(tok) - 1)
                pick = tok[at] == seq
                for (c, j), (order, good) in class_orders(seq[pick], num[at[pick]], role[at[pick]], known.setdefault(host, set())).items():
                    row = sums.setdefault((host, c, j), [order, order, True])
                    row[:] = [min(row[0], order), max(row[1], order), row[2] and good]
        cols = [*([k[i] for k in sums] for i in range(3)), *([v[i] for v in sums.values()] for i in range(3))]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "number", "role", "low", "high", "good"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for rows, wrong in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            large = _large(rows)
            bad = frozenset(large[w["number"]][0] for w in wrong or () if w["role"] < 0)
            parts = [(large[w["number"]], w["role"]) for w in wrong or () if w["role"] >= 0]
            out.append(template(rows, bad, frozenset((k, list(by_role(v))[j]) for (k, v), j in parts if k in bad)))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in cols[1:])], ["host", "slot", "out", "words"])


def _extract(spare: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, slot, out, words in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                texts.append(main_text(html.as_py(), (slot, frozenset(out.as_py() or ()), frozenset(words.as_py() or ())), spare))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def templates(pages: DataFrame) -> tuple[DataFrame, Template]:
    """(host, slot, out, words) from pages (host, page, html), and the template that hosts of few pages share."""
    spark = pages.sparkSession
    here = spark.sparkContext.broadcast(_field(pages.select("host", "html").mapInArrow(_often_here, "b long")))
    seen = pages.mapInArrow(_occurrences(here), _SEEN).groupBy("host", "token")
    sums = [F.max("at").alias("at"), F.max("tag").alias("tag"), *(F.sum(c).alias(c) for c in ("pages", "times", "chars", "links", "one", "two"))]
    most = pages.groupBy("host").agg(F.count("*").alias("all"))
    often = C.written(seen.agg(*sums).join(most, "host").where((F.col("pages") >= SUPPORT * F.col("all")) | (F.col("all") < LEAST_PAGES)), "often")  # rarer tokens are in no valid class
    row = F.struct("token", "at", "tag", "pages", "times", F.xxhash64("one", "two").alias("vector"), "chars", "links")
    hosts = C.written(often.where(F.col("all") >= LEAST_PAGES).groupBy("host").agg(F.collect_list(row).alias("rows")), "hosts")

    few = often.where((F.col("all") < LEAST_PAGES) & F.col("tag").isNotNull()).groupBy("token").agg(*sums)
    total = few.where("token = 0").agg(F.sum("pages")).first()[0] or 0
    pool = [r.asDict() | {"vector": hash((r.one, r.two))} for r in few.where(F.col("pages") >= SUPPORT * total).collect()] if total >= LEAST_PAGES else []  # at most the elements of two average pages
    slot, out, _ = template(pool) if pool else (None, [], [])

    found = C.written(hosts.mapInArrow(_candidates, "host string, tokens array<long>, numbers array<long>, roles array<long>, bits array<long>"), "candidates")
    field = _field(found.select(F.explode("bits").alias("b")))
    reduced = pages.mapInArrow(_reduced(spark.sparkContext.broadcast(field)), "host string, sequence array<long>")
    orders = reduced.join(found.select("host", "tokens", "numbers", "roles"), "host").mapInArrow(_orders, "host string, number long, role long, low long, high long, good boolean")
    wrong = orders.groupBy("host", "number", "role").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("good").alias("good")).where("low <> high or not good")
    wrong = wrong.groupBy("host").agg(F.collect_list(F.struct("number", "role")).alias("wrong"))
    slots = hosts.join(wrong, "host", "left").select("host", "rows", "wrong").mapInArrow(_slots, "host string, slot long, out array<long>, words array<long>")
    return slots, (slot, frozenset(out), frozenset())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text and n_chars (its code points)."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(host.alias("host"), F.col(id_col).cast("long").alias("id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    slots, spare = templates(rows.select("host", F.xxhash64("id", "url", "html").alias("page"), "html"))
    out = rows.join(slots, "host", "left").select("id", "url", "html", "slot", "out", "words").mapInArrow(_extract(spare), "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
