"""Page boilerplate mixed with main content (problem 1), by suffix arrays over each host's page token streams.

The pages of a host, in shards of about SHARD_PAGES pages, become one stream of tokens: a line mark, then the words of
the line in lower case with digits masked. A suffix array finds the substrings that stand in several distinct pages,
however long they are. Lines that lie in them are covered and removed; what remains are unique runs.

What is covered says what a container (the path of elements around a line) is for. A container of which COVERED lines
are covered holds furniture, and so does one whose lines all open with one of a few repeated substrings (Tags:,
Related:); its unique lines, names and links that fill a template, go with it. A container of unique runs is body
and stays, and so does always the container with most unique words of a page. A container seen too seldom to tell, and
lines outside all containers, are ties: the votes of the host's pages for their main container break them. Without the
suffix array nothing is covered, no container is furniture, and next to nothing is removed.

The lines of clean_text are then looked up among the page's removed and kept lines (an exact check). Where the page is
lost, or doesn't hold the line, what the host's other pages taught decides: how lines of the same words, of the same
form and place, or covered lines were judged there.

Shards are hash parts of one host and never hold more than a bounded number of pages, so a host with a third of all
pages is many shards. Everything within a shard is arrays; no pair of pages is ever compared. What counts is the host,
not the shard: the pages of a substring (by the hash of its tokens), the lines, openings and votes of a container, the
votes on a form, a word, a mask, a place are added up over the host's shards, and each shard gets back what concerns
its own lines. So the rows don't depend on how a host is cut into shards.

Defined results: rows without raw_html_path are left out; null and empty texts have no lines; an empty line is never
reported. Pages that are lost, null or broken are treated as lost. Repeated rows of one id count once. A host that has
too little to learn from falls back on votes, place and punctuation. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetry.llm import textkit as tk
from quillmetry.llm.fmindex import suffix_array
from quillmetry.runtime import broadcast_if_small, rows_of, written

SHARD_PAGES = 1000
#: Bytes of lines that are cut into words at once.
CHUNK_CHARS = 250_000
#: A substring is boilerplate from so many tokens (line marks count) in so many distinct pages on.
LEAST_TOKENS, LEAST_PAGES = 3, 3
#: A container holds furniture from this share of covered lines on, if its unique runs have fewer words a page than LONG_RUN:
#: a body repeats a line of its own now and then, and its runs are long.
COVERED, LONG_RUN = 0.03, 100
#: Or if OPENINGS repeated openings begin this share of its lines. A container of fewer lines is a tie.
OPENINGS, OPENED, LEAST_LINES = 4, 0.95, 6
#: A container is taken for a page's main one first if more than this share of the pages say so.
MAIN = 0.02
#: A container with nothing against it is body from so many pages on with long unique runs, or with short ones.
ENOUGH_PAGES, MANY_PAGES = 5, 30

#: Votes that a line's form, head and mask need; without any a line of LONG_LINE words is body, others go by LEAST_VOTES of their shape.
_LEVELS = (("form", 1), ("head", 1), ("mask", 2))
LONG_LINE, LEAST_VOTES = 14, 3

_MARK = np.uint64(0x5851F42D4C957F2D)
_DROP = re.compile(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|head|template)\b.*?</\1\s*>")
_MARKUP = re.compile(r"<(/?)([a-zA-Z][\w-]*)([^>]*)>|([^<]+)|<")
_CLASS = re.compile(r"""class\s*=\s*["']([^"']*)["']""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi cite code em font i kbd mark q s span strong sub sup time u var".split())
_PLAIN = _INLINE | frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre html body".split())
_WORD = re.compile(r"[^\W_]+")
_HEAD = re.compile(r"[^:>|]{2,24}[:>|]")
_DIGITS = re.compile(r"\d[\d.,]*")


def page_lines(source: str) -> list[tuple[str, str]]:
    """Container and text of each block of a page. The container is the path of elements that are more than plain text."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []

    def flush() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((">".join(name for _, name in stack if name), html_entities.unescape(line)))

    for closing, tag, rest, chars in _MARKUP.findall(_DROP.sub(" ", source or "")):
        if chars:
            text.append(chars)
        elif tag:
            tag = tag.lower()
            name = _CLASS.search(rest) if not closing else None
            if tag in _VOID:
                if tag in ("br", "hr"):
                    flush()
            elif not closing:
                if name or tag not in _INLINE:
                    flush()
                stack.append((tag, f"{tag}.{name[1]}" if name else "" if tag in _PLAIN else tag))
            else:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if at is not None:
                    if tag not in _INLINE or stack[at][1]:
                        flush()
                    del stack[at:]
    flush()
    return out


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_path and its lines as container, unit separator, text, joined by record separators."""
    return pages.filter("page_path is not null and html is not null").select("page_path", "html").mapInArrow(_parsed, "page_path string, page string")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in tk.chunks(whole, "html"):
            lines = ["\x1e".join(f"{c}\x1f{t}" for c, t in page_lines(h)) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_path"), pa.array(lines, pa.string())], names=["page_path", "page"])


def key_of(line: str) -> str:
    """Letters and digits only: what layout, case and white space can't change."""
    return "".join(_WORD.findall(line.lower()))


def form_of(line: str) -> str:
    return _DIGITS.sub("#", " ".join(line.lower().split()))


def _tokens(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of each word of the lines, by chunks: arrays over characters take most memory, so none is over a whole shard."""
    rows, hashes, at = [], [], 0
    for part in tk.chunks(pa.RecordBatch.from_arrays([pa.array(forms, pa.string())], names=["form"]), "form", CHUNK_CHARS):
        words = tk.words_of(part.column("form"))
        rows.append(words.row + at)
        hashes.append(words.hash)
        at += part.num_rows
    return np.concatenate(rows), np.concatenate(hashes)


def line_keys(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each line of the documents (lists of lines), the distinct keys, and in how many documents each stands.

    A key is the hash of a substring, so it is the same in every shard; 0 is none. The first is the line's words with both
    line marks. A line without words is too short a substring: it is taken with the token before it, or (second key) the
    one after it. The third is the line's opening, line mark and first word. The suffix array brings equal substrings together.
    """
    forms = [form_of(line).replace("#", " 0 ") for lines in streams for line in lines]
    per_doc = np.fromiter((len(x) for x in streams), np.int64, len(streams))
    n_lines = len(forms)
    if n_lines == 0:
        return np.zeros((0, 3), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row, token = _tokens(forms)
    symbols, code = np.unique(token, return_inverse=True)
    in_line = np.bincount(row, minlength=n_lines)
    doc_of_line = np.repeat(np.arange(len(streams)), per_doc)
    # line marks stand before every line and after a document's last one, then an end that is unique, so no repeat crosses it
    gap = np.r_[doc_of_line[1:] != doc_of_line[:-1], True]
    size = in_line + 1 + 2 * gap
    start = np.r_[0, np.cumsum(size)[:-1]]
    t = np.zeros(int(size.sum()), np.int64)
    first = np.r_[0, np.cumsum(in_line)[:-1]]
    place = start[row] + 1 + np.arange(len(code)) - first[row]
    t[place] = code + 1
    ends = (start + size)[gap] - 1
    t[ends] = len(symbols) + 1 + np.arange(len(ends))
    value = np.full(len(t), _MARK, np.uint64)
    value[place] = token
    # the substrings: of which line, as which key, from where, how long
    bare = np.flatnonzero(in_line == 0)
    before = bare[(start[bare] > 0) & (t[start[bare] - 1] <= len(symbols))]
    after = bare[(start[bare] + 2 < len(t)) & (t[np.minimum(start[bare] + 2, len(t) - 1)] <= len(symbols))]
    full = np.flatnonzero(in_line)
    line = np.r_[full, before, after]
    slot = np.repeat([0, 0, 1], [len(full), len(before), len(after)])
    at = np.r_[start[full], start[before] - 1, start[after]]
    need = np.r_[in_line[full] + 2, np.full(len(before) + len(after), LEAST_TOKENS)]
    keys = np.zeros((n_lines, 3), np.uint64)
    keys[line, slot] = tk.span_hashes(tk.prefix_hashes(value), at, at + need)
    keys[full, 2] = tk.mix(token[first[full]] ^ _MARK)
    depth = int(in_line.max()) + 2
    order = suffix_array(t, depth)
    common = _common_prefixes(t, order, depth)
    rank = np.empty(len(t), np.int64)
    rank[order] = np.arange(len(t))
    by = np.argsort(rank[at], kind="stable")
    line, slot, need, sorted_rank = line[by], slot[by], need[by], rank[at][by]
    if not len(by):
        return keys, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shared = np.minimum.reduceat(np.r_[common, 0], sorted_rank)[:-1]
    same = (need[1:] == need[:-1]) & ((shared >= need[:-1]) | (sorted_rank[1:] == sorted_rank[:-1]))
    group = np.cumsum(np.r_[True, ~same]) - 1
    head = np.flatnonzero(np.r_[True, ~same])
    pages = np.bincount(np.unique(group * len(streams) + doc_of_line[line]) // len(streams))
    opening, which = np.unique(keys[full, 2], return_inverse=True)
    opening_pages = np.bincount(np.unique(which * len(streams) + doc_of_line[full]) // len(streams), minlength=len(opening))
    return keys, np.r_[keys[line[head], slot[head]], opening], np.r_[pages, opening_pages]


def lines_known(keys: np.ndarray, known: np.ndarray, per_doc: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each document which lines are covered and which have a repeated opening, by the keys known as repeated."""
    hit = np.isin(keys, known)
    cuts = np.cumsum(per_doc)[:-1].astype(np.int64)
    if not len(per_doc):
        return [], []
    return np.split(hit[:, 0] | hit[:, 1], cuts), np.split(hit[:, 2], cuts)


def covered_lines(streams: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each document (a list of lines) which lines lie wholly, with both line marks, in a repeated substring, and which
    have an opening (line mark and first word) that is repeated."""
    keys, distinct, pages = line_keys(streams)
    return lines_known(keys, distinct[pages >= LEAST_PAGES], [len(x) for x in streams])


def _common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix, depth at most, of each suffix in the order with the next one."""
    n = len(t)
    a, b = order[:-1], order[1:]
    out = np.zeros(max(n - 1, 0), np.int64)
    live = np.arange(len(out))
    for d in range(depth):
        live = live[(a[live] + d < n) & (b[live] + d < n)]
        live = live[t[a[live] + d] == t[b[live] + d]]
        if not len(live):
            break
        out[live] += 1
    return out


def container_counts(blocks: list[list[tuple[str, str]]], covered: list[np.ndarray], opened: list[np.ndarray]) -> tuple[dict[str, list[int]], dict[str, Counter[str]]]:
    """Of each container its lines, covered lines, pages, unique words and the pages that have most unique words in it; the
    repeated openings of its unique lines. All of them add up over shards."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0] * 5)
    openings: dict[str, Counter[str]] = defaultdict(Counter)
    for b, c, o in zip(blocks, covered, opened):
        for container in {container for container, _ in b}:
            counts[container][2] += 1
        for (container, text), known, begun in zip(b, c, o):
            n = counts[container]
            n[0] += 1
            if known:
                n[1] += 1
            else:
                n[3] += len(text.split())
                if begun:
                    openings[container][_WORD.search(text.lower())[0]] += 1
        if mass := _mass(b, c):
            counts[max(mass, key=mass.get)][4] += 1
    return counts, openings


def _mass(block: list[tuple[str, str]], covered: np.ndarray) -> Counter[str]:
    """Unique words of a page by container."""
    mass: Counter[str] = Counter()
    for (container, text), known in zip(block, covered):
        if not known:
            mass[container] += len(text.split())
    return mass


def container_roles(counts: dict[str, list[int]], openings: dict[str, Counter[str]]) -> tuple[dict[str, bool], dict[str, int]]:
    """Containers that hold furniture (True) or body (False) by what is covered of them; ties have no entry. And the votes
    of pages for their main container, but for those of under MAIN of the pages."""
    out = {}
    for container, (n, hidden, pages, unique, _) in counts.items():
        few = sum(k for _, k in openings[container].most_common(OPENINGS)) if container in openings else 0
        long = unique >= LONG_RUN * pages
        if not long and (hidden >= COVERED * n or (n >= LEAST_LINES and few >= OPENED * (n - hidden))):
            out[container] = True
        elif container and pages >= (ENOUGH_PAGES if long else MANY_PAGES):
            out[container] = False
    least = MAIN * sum(n[4] for n in counts.values())
    return out, {container: n[4] for container, n in counts.items() if n[4] > least}


def _zones(lines: list[str], known: set[str]) -> list[str]:
    """Head or tail: before or after the long lines that aren't known as furniture; else between two of them, or else.

    Known furniture and empty lines don't count as neighbours; a list entry counts as prose.
    """
    rest = [i for i, x in enumerate(lines) if x.strip() and form_of(x) not in known]
    long = {i for i in rest if len(lines[i].split()) >= 12}
    if not long:
        return ["m"] * len(lines)
    prose = long | {i for i in rest if lines[i].lstrip()[:1] in "-•*–"}
    first, last = min(long), max(long)
    out = ["h" if i < first else "t" if i > last else "m" for i in range(len(lines))]
    for before, i, after in zip(rest, rest[1:], rest[2:]):
        if before in prose and after in prose and first < i < last:
            out[i] = "i"
    return out


def _shape(line: str) -> tuple:
    n = len(line.split())
    return (line.rstrip()[-1:] in ".!?\"”»…", min(n // 4, 4), line.lstrip()[:1] in "-•*–#(")


class _Judge:
    """What sure lines teach about others: votes of furniture against body, from the most exact form to the coarsest."""

    def __init__(self, kept: set[str]):
        self.kept = kept
        self.votes = [defaultdict(lambda: [0, 0]) for _ in range(4)]

    def learn(self, line: str, zone: str, bad: bool) -> None:
        for table, key in zip(self.votes, self.keys(line, zone)):
            table[key][bad] += 1

    def keys(self, line: str, zone: str) -> tuple:
        form = form_of(line)
        mask = re.sub(r"x( x)+", "x", " ".join(w if w in self.kept else "x" for w in form.split()))
        head = _HEAD.match(form)
        return form, (zone, mask), (zone, *_shape(line)), head[0] if head else ""

    def edge(self, line: str, zone: str) -> bool:
        """Before or after the story, without the end of a sentence or the mark of a list."""
        stop, _, mark = _shape(line)
        return zone in "ht" and not stop and not mark

    def furniture(self, line: str, zone: str, covered: bool) -> bool:
        keys = dict(zip(("form", "mask", "shape", "head"), zip(self.votes, self.keys(line, zone))))
        for level, least in _LEVELS:
            table, key = keys[level]
            if level == "head" and not key:
                continue
            body, bad = table.get(key, (0, 0))
            if body + bad >= least and body != bad:
                return bad > body
        if covered:
            return True
        if len(line.split()) >= LONG_LINE:
            return False
        table, key = keys["shape"]
        body, bad = table.get(key, (0, 0))
        return bad > body if body + bad >= LEAST_VOTES else self.edge(line, zone)


def _by_page(lines: list[str], kept: list[str], removed: list[str]) -> dict[int, bool]:
    """Of the lines that the page holds whether they are furniture: among its removed lines or the kept ones."""
    body, rest = {key_of(t) for t in kept}, {key_of(t) for t in removed}
    body_text, rest_text = "\n".join(sorted(body)), "\n".join(sorted(rest))
    keys = [key_of(line) for line in lines]
    inner = [i for i, k in enumerate(keys) if k in body and k not in rest]
    got: dict[int, bool] = {}
    for i, key in enumerate(keys):
        if not key:
            continue
        if (key in body) != (key in rest):
            got[i] = key in rest
        elif key in body:  # as a crosshead and as a link: it is the crosshead if body lines stand on both sides
            got[i] = not (inner and inner[0] < i < inner[-1])
        elif len(key) >= 12 and key in body_text:
            got[i] = False
        elif len(key) >= 4 and key in rest_text:
            got[i] = True
    return got


def page_parts(blocks: list[list[tuple[str, str]]], covered: list[np.ndarray], roles: dict[str, bool], votes: dict[str, int]) -> list[tuple[list[str], list[str]]]:
    """The kept and the removed lines of each page."""
    out = []
    for b, c in zip(blocks, covered):
        mass = _mass(b, c)
        main = max(mass, key=lambda x: (not roles.get(x, False), votes.get(x, 0), mass[x])) if mass else None
        kept: list[str] = []
        removed: list[str] = []
        for container, text in b:
            (kept if container == main or roles.get(container) is False else removed).append(text)
        out.append((kept, removed))
    return out


def _blocks(pages: list[str | None]) -> list[list[tuple[str, str]]]:
    return [[tuple(x.split("\x1f", 1)) for x in p.split("\x1e")] if p else [] for p in pages]


def _lines(texts: list[str]) -> list[list[str]]:
    return [t.split("\n") if t else [] for t in texts]


def _streams(blocks: list[list[tuple[str, str]]], lines: list[list[str]]) -> list[list[str]]:
    """A page's stream is its own lines, or the text's where the page is lost."""
    return [[t for _, t in b] if b else x for b, x in zip(blocks, lines)]


def sure_lines(blocks: list[list[tuple[str, str]]], lines: list[list[str]], covered: list[np.ndarray], roles: dict[str, bool], votes: dict[str, int]) -> list[dict[int, bool]]:
    """Of the lines of each text that its page holds whether they are furniture."""
    parts = page_parts(blocks, covered, roles, votes)
    return [_by_page(x, kept, removed) if b else {} for b, x, (kept, removed) in zip(blocks, lines, parts)]


def form_votes(lines: list[list[str]], sure: list[dict[int, bool]]) -> tuple[dict[str, list[int]], Counter[str]]:
    """Of each form how many of its sure lines are body and furniture, and the furniture lines that hold a word."""
    forms: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    words: Counter[str] = Counter()
    for x, got in zip(lines, sure):
        for i, bad in got.items():
            form = form_of(x[i])
            forms[form][bad] += 1
            if bad:
                words.update(set(form.split()))
    return forms, words


def shard_lines(ids: list[str], texts: list[str], pages: list[str | None]) -> list[tuple[str, int]]:
    """The lines of one shard's articles that are no body, where it holds all pages of the host: id, line number from 1."""
    blocks, lines = _blocks(pages), _lines(texts)
    covered, opened = covered_lines(_streams(blocks, lines))
    sure = sure_lines(blocks, lines, covered, *container_roles(*container_counts(blocks, covered, opened)))
    forms, words = form_votes(lines, sure)
    known = {f for f, (body, bad) in forms.items() if bad > body}
    zones = [_zones(x, known) for x in lines]
    judge = _Judge({w for w, c in words.items() if c >= LEAST_PAGES})
    for x, zone, got in zip(lines, zones, sure):
        for i, bad in got.items():
            judge.learn(x[i], zone[i], bad)
    out = []
    for ident, x, zone, got, b, c in zip(ids, lines, zones, sure, blocks, covered):
        for i, line in enumerate(x):
            if line.strip() and (got[i] if i in got else judge.furniture(line, zone[i], bool(not b and c[i]))):
                out.append((ident, i + 1))
    return out


def _packed(state: tuple) -> bytes:
    raw = pickle.dumps(state, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(cell: pa.ChunkedArray) -> tuple:
    held = cell[0].as_py()
    return pickle.loads(pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True))


def _hash(kind: str, key: object) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _where(t: pa.Table) -> tuple[str, int]:
    return t.column("host")[0].as_py(), t.column("shard")[0].as_py()


def _rows(schema: str, host: str, shard: int, *parts: dict[str, list]) -> pa.Table:
    """Rows of several kinds in one table: the columns a part doesn't name are null."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    tables = []
    for part in parts:
        n = len(next(iter(part.values())))
        part = part | {"host": [host] * n, "shard": [shard] * n}
        tables.append(pa.table([pa.array(part[f.name], f.type) if f.name in part else pa.nulls(n, f.type) for f in fields], schema=fields))
    return pa.concat_tables(tables)


_KEYS = "host string, shard bigint, state binary, key bigint, pages bigint"
_CONTAINERS = "host string, shard bigint, container string, word string, lines bigint, hidden bigint, pages bigint, uniq bigint, votes bigint"
_FORMS = "host string, shard bigint, state binary, key bigint, word boolean, body bigint, bad bigint"
_VERDICTS = "host string, shard bigint, id string, line_no bigint, form bigint, head bigint, mask bigint, shape bigint, covered boolean, long boolean, edge boolean, key bigint, body bigint, bad bigint"


def _count_keys(t: pa.Table) -> pa.Table:
    """The shard's articles and pages as one state, and its keys with the pages they stand in."""
    rows: dict[str, tuple[str, str | None]] = {}
    for ident, text, page in zip(*(t.column(c).to_pylist() for c in ("id", "clean_text", "page"))):
        rows.setdefault(ident, (text, page))
    ids = sorted(rows)
    texts, pages = [rows[i][0] for i in ids], [rows[i][1] for i in ids]
    keys, distinct, count = line_keys(_streams(_blocks(pages), _lines(texts)))
    return _rows(_KEYS, *_where(t), {"state": [_packed((ids, texts, pages, keys))]}, {"key": distinct.view(np.int64), "pages": count})


def _covered(t: pa.Table) -> tuple:
    ids, texts, pages, keys = _unpacked(t.column("state"))
    blocks, lines = _blocks(pages), _lines(texts)
    known = np.array(t.column("known")[0].as_py() or [], np.int64).view(np.uint64)
    return ids, texts, lines, blocks, *lines_known(keys, known, [len(x) for x in _streams(blocks, lines)])


def _count_containers(t: pa.Table) -> pa.Table:
    _, _, _, blocks, covered, opened = _covered(t)
    counts, openings = container_counts(blocks, covered, opened)
    whole = dict(zip(("lines", "hidden", "pages", "uniq", "votes"), map(list, zip(*counts.values())))) if counts else {"lines": []}
    begun = [(c, w, n) for c, words in openings.items() for w, n in words.items()]
    return _rows(_CONTAINERS, *_where(t), {"container": list(counts)} | whole, {"container": [c for c, _, _ in begun], "word": [w for _, w, _ in begun], "lines": [n for _, _, n in begun]})


def _count_forms(t: pa.Table) -> pa.Table:
    """The sure lines as the next state, the votes for every form of the shard, and the furniture lines with each of its words."""
    ids, texts, lines, blocks, covered, _ = _covered(t)
    roles, votes = {}, {}
    for x in t.column("roles")[0].as_py() or []:
        if x["role"] is not None:
            roles[x["container"]] = x["role"]
        votes[x["container"]] = x["votes"]
    sure = sure_lines(blocks, lines, covered, roles, votes)
    voted, words = form_votes(lines, sure)
    forms = {form_of(line) for x in lines for line in x if line.strip()}
    forms, every = list(forms), list({w for f in forms for w in f.split()})
    lost = [[i for i, hit in enumerate(c) if hit] if not b else [] for b, c in zip(blocks, covered)]
    held = [voted[f] if f in voted else (0, 0) for f in forms]
    return _rows(_FORMS, *_where(t), {"state": [_packed((ids, texts, sure, lost))]}, {"key": [_hash("f", f) for f in forms], "word": [False] * len(forms), "body": [x for x, _ in held], "bad": [x for _, x in held]}, {"key": [_hash("w", w) for w in every], "word": [True] * len(every), "body": [0] * len(every), "bad": [words[w] for w in every]})


def _verdicts(t: pa.Table) -> pa.Table:
    """Sure lines that are furniture (id, line_no alone), lines to be asked for with their keys, and the votes of the sure lines by key."""
    ids, texts, sure, lost = _unpacked(t.column("state"))
    lines, told = _lines(texts), set(t.column("known")[0].as_py() or [])
    forms = {form_of(line) for x in lines for line in x if line.strip()}
    known = {f for f in forms if _hash("f", f) in told}
    judge = _Judge({w for w in {w for f in forms for w in f.split()} if _hash("w", w) in told})
    found: list[tuple[str, int]] = []
    asked: list[tuple] = []
    for ident, x, got, hit in zip(ids, lines, sure, lost):
        zone, hit = _zones(x, known), set(hit)
        for i, line in enumerate(x):
            if i in got:
                judge.learn(line, zone[i], got[i])
                if got[i] and line.strip():
                    found.append((ident, i + 1))
            elif line.strip():
                keys = [_hash(str(k), key) if k != 3 or key else None for k, key in enumerate(judge.keys(line, zone[i]))]
                asked.append((ident, i + 1, keys[0], keys[3], keys[1], keys[2], i in hit, len(line.split()) >= LONG_LINE, judge.edge(line, zone[i])))
    votes = [(_hash(str(k), key), body, bad) for k, table in enumerate(judge.votes) for key, (body, bad) in table.items()]
    part = lambda names, rows: dict(zip(names.split(), map(list, zip(*rows)))) if rows else {names.split()[0]: []}
    return _rows(_VERDICTS, *_where(t), part("id line_no", found), part("id line_no form head mask shape covered long edge", asked), part("key body bad", votes))


def boilerplate_lines(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """id, line_no of the lines of clean_text that are no part of the story's own body."""
    path = F.regexp_replace("raw_html_path", r"^raw/(\d{4})\.tar\.gz:(.+)$", "raw/$1/$2")
    a = articles.filter("raw_html_path is not null and trim(raw_html_path) != '' and id is not null and clean_text is not null and clean_text != ''")
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1)), F.lit("")), F.lit("unknown"))
    a = a.select("id", host.alias("host"), path.alias("page_path"), "clean_text")
    sizes = written(a.groupBy("host").agg(F.ceil(F.count("*") / SHARD_PAGES).alias("shards")), "hosts")
    a = a.join(broadcast_if_small(sizes, rows_of(sizes)), "host")
    joined = a.join(parsed_pages(pages), "page_path", "left")
    keyed = joined.select("host", F.pmod(F.xxhash64("id"), "shards").alias("shard"), "id", "clean_text", "page")
    place = ["host", "shard"]

    # substrings: pages over the whole host; each shard learns which of its keys stand in enough of them
    counted = written(keyed.groupBy(*place).applyInArrow(_count_keys, _KEYS), "keys")
    often = counted.filter("key is not null").groupBy("host", "key").agg(F.sum("pages").alias("pages"), F.collect_list("shard").alias("shards")).filter(F.col("pages") >= LEAST_PAGES)
    covered = _told(often, F.col("key"))
    states = counted.filter("state is not null").select(*place, "state").join(covered, place, "left")

    # containers: their roles and votes over the whole host
    containers = written(states.groupBy(*place).applyInArrow(_count_containers, _CONTAINERS), "containers")
    opened = containers.filter("word is not null").groupBy("host", "container", "word").agg(F.sum("lines").alias("n"))
    nth = F.row_number().over(Window.partitionBy("host", "container").orderBy(F.desc("n")))
    few = opened.withColumn("nth", nth).filter(F.col("nth") <= OPENINGS).groupBy("host", "container").agg(F.sum("n").alias("few"))
    of_shard = containers.filter("word is null")
    whole = of_shard.groupBy("host", "container").agg(*[F.sum(c).alias(c) for c in ("lines", "hidden", "pages", "uniq", "votes")])
    whole = whole.join(of_shard.groupBy("host").agg(F.sum("votes").alias("all_votes")), "host").join(few, ["host", "container"], "left")
    long = F.col("uniq") >= LONG_RUN * F.col("pages")
    furniture = ~long & ((F.col("hidden") >= COVERED * F.col("lines")) | ((F.col("lines") >= LEAST_LINES) & (F.coalesce("few", F.lit(0)) >= OPENED * (F.col("lines") - F.col("hidden")))))
    body = (F.col("container") != "") & (F.col("pages") >= F.when(long, ENOUGH_PAGES).otherwise(MANY_PAGES))
    role = F.when(furniture, True).when(body, False)
    main = F.when(F.col("votes") > MAIN * F.col("all_votes"), F.col("votes")).otherwise(0)
    roles = of_shard.select(*place, "container").join(whole.select("host", "container", role.alias("role"), main.alias("votes")), ["host", "container"])
    roles = roles.groupBy(*place).agg(F.collect_list(F.struct("container", "role", "votes")).alias("roles"))

    # forms and words: whether the host's sure lines of a form are furniture, in how many of those a word stands
    formed = written(states.join(roles, place, "left").groupBy(*place).applyInArrow(_count_forms, _FORMS), "forms")
    sums = [F.sum(c).alias(c) for c in ("body", "bad")]
    voted = formed.filter("key is not null").groupBy("host", "key", "word").agg(*sums, F.collect_list("shard").alias("shards"))
    voted = voted.filter(F.when(F.col("word"), F.col("bad") >= LEAST_PAGES).otherwise(F.col("bad") > F.col("body")))
    labelled = formed.filter("state is not null").select(*place, "state").join(_told(voted, F.col("key")), place, "left")

    # what isn't sure is asked of the votes of the whole host, from the most exact form to the coarsest
    verdicts = written(labelled.groupBy(*place).applyInArrow(_verdicts, _VERDICTS), "verdicts")
    found = verdicts.filter("id is not null and form is null").select("id", "line_no")
    asked = verdicts.filter("form is not null")
    levels = ("form", "head", "mask", "shape")
    wanted = asked.select("host", F.explode(F.array(*levels)).alias("key")).distinct()
    votes = verdicts.filter("id is null").select("host", "key", "body", "bad").join(wanted, ["host", "key"], "left_semi").groupBy("host", "key").agg(*sums)
    each = asked.select("host", "shard", "id", "line_no", "covered", "long", "edge", F.posexplode(F.array(*levels)).alias("level", "key")).join(votes, ["host", "key"], "left")
    line = each.groupBy("host", "shard", "id", "line_no", "covered", "long", "edge").agg(*[F.max(F.when(F.col("level") == k, F.struct(F.coalesce("body", F.lit(0)).alias("body"), F.coalesce("bad", F.lit(0)).alias("bad")))).alias(c) for k, c in enumerate(levels)])
    return found.unionByName(line.filter(_decided()).select("id", "line_no"))


def _told(often: DataFrame, key: Column) -> DataFrame:
    """host, shard and the keys that its host knows, for each shard that holds them."""
    return often.select("host", F.explode("shards").alias("shard"), key.alias("key")).groupBy("host", "shard").agg(F.collect_list("key").alias("known"))


def _decided() -> Column:
    """_Judge.furniture on the votes of a line's keys."""
    verdict = F.lit(None).cast("boolean")
    n = lambda c: F.col(f"{c}.body") + F.col(f"{c}.bad")
    more = lambda c: F.col(f"{c}.bad") > F.col(f"{c}.body")
    last = F.when(F.col("covered"), True).when(F.col("long"), False).when(n("shape") >= LEAST_VOTES, more("shape")).otherwise(F.col("edge"))
    for level, least in reversed(_LEVELS):
        told = (n(level) >= least) & (F.col(f"{level}.body") != F.col(f"{level}.bad"))
        verdict = F.when(told, more(level)).otherwise(last if level == _LEVELS[-1][0] else verdict)
    return verdict
