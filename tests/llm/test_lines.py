"""Residue, repeated lines, truncation and page bodies on small texts."""

from __future__ import annotations

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from quillmetry.llm import boilerplate as bp
from quillmetry.llm import residue, sitelines, truncation
from quillmetry.llm.fmindex import FmIndex, WaveletMatrix, suffix_array

STORY = "The board approved the budget on Friday after a long debate in the town hall. Nobody opposed it."


@pytest.mark.parametrize("text", ["Dear {{ first_name }}, hello", "a ${article.section} b", "x #{county} y", "see %HEADLINE% now", "for %(name)s now", "__CITY__ council", "at <%= byline %> end", "{% if region %} x", "|FNAME| wrote", "[[source needed: NAME]]", "[INSERT QUOTE HERE]", "[TK percent] of", "[Your Name] said", "said <PERSON_1> today", "on XX/XX/XXXX at", "[object Object] voted", "TK TK TK", "Lorem ipsum dolor sit amet, consectetur elit.", "404 Not Found\nThe page you are looking for was moved.", "Please enable JavaScript to continue reading.", "<noscript>This site works only with scripts switched on.</noscript>", "Access denied", "Loading...", "[HTTP_ERROR:403]", "Story.\n\nBody copy goes here", "A story.\n```\nDear {{ first_name }}, hello", "Dear {{ " + "very_" * 20 + "long_name }}, hello", "The template is ready for the council meeting on Monday evening, when members will discuss roads and water, she said. Dear {{ name }}, we met. Dear {{ name }}, bye."])
def test_residue(spark, text):
    assert residue.found_residue(spark.createDataFrame([("a", f"{text}")], "id string, clean_text string")).count() == 1


@pytest.mark.parametrize("text", [None, "", "  ", STORY, STORY + " The page returned a 404 error for 6 days, she said.", 'I saw the words access denied and a request to enable JavaScript," she recalled.', "The lorem ipsum on slide 9 was a joke.", "We [the board] never saw it [sic] before.", "Use `{{ name }}` in the template.", "```\n{{ name }} ${x}\n```\nThat is the syntax.", "The brochure still held placeholder text.", "Prices rose 5 % and 7 % {unlike before}.", "Use template variables like {{ name }} or {{ title }} in templates. The placeholder syntax is {{ other }}."])
def test_no_residue(spark, text):
    assert residue.found_residue(spark.createDataFrame([("a", text)], "id string, clean_text string")).count() == 0


def test_repeated_lines_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        lines = ["", f"  Read all {i} replies ", "share   THIS story", *[f"body line {i} number {k} " + "word " * 20 for k in range(3)], str(rng.choice(["rare one", "Rare  one", "tail 7"]))]
        rows.append((f"id{i}", str(rng.choice(["hot", "hot", "b", "c"])), "\n".join(lines), 1))
    rows += [("n", "hot", None, 1), ("e", "hot", "", 1), ("s", "hot", "share this story", 1), ("x", None, "share this story\n" + "word " * 60, 1), rows[0]]
    df = spark.createDataFrame(rows, "id string, source string, text string, line_no int")
    got = {(r.id, r.line_no) for r in sitelines.repeated_lines(df, "source").collect()}
    docs, places = collections.defaultdict(set), collections.defaultdict(set)
    for i, s, t, _ in rows:
        if s and t and len(t.split()) >= 50:
            for n, line in enumerate(t.split("\n"), 1):
                key = re.sub(r"\d+", "#", " ".join(line.split()).lower())
                if key:
                    docs[s, key].add(i)
                    places[s, key].add((i, n))
    assert got == {p for k, v in docs.items() if len(v) >= 6 for p in places[k]}
    kept = {r.id: r.text for r in sitelines.without_lines(df.select("id", "text"), sitelines.repeated_lines(df, "source")).collect()}
    assert "share" not in kept["id1"].lower() and kept["s"] == "share this story" and kept["n"] is None


def test_truncation(spark):
    words = " ".join(["The council met on Monday and approved every proposal that the mayor had sent."] * 6)
    known = [(f"k{i}", "a", "How A lost 9 jobs to B", words + " Residents complained loudly about the decision.", None) for i in range(4)]
    rows = [*known, ("cut", "a", "T", words + " Residents compl", 900), ("mark", "a", "T", words + " Residents were told…", 78), ("whole", "a", "T", words, 84), ("list", "a", "T", words + "\n- Town: 5 votes", 84), ("link", "a", "T", words + "\nhttps://x.example/clip/1", 84), ("null", "a", "T", None, None), ("empty", "a", "T", "", 0)]
    df = spark.createDataFrame(rows, "id string, author_id string, title string, clean_text string, word_count bigint")
    assert {r.id for r in truncation.found_truncated(df).collect()} == {"cut", "mark"}
    assert truncation.found_truncated(df.limit(0)).count() == 0
    authors = spark.createDataFrame([("a", "o")], "id string, outlet string")
    rate = truncation.truncation_rates(df, authors).first()
    assert (rate.articles, rate.cut) == (11, 2)


def test_truncation_by_trie_and_length(spark):
    words = "The council met on Monday and approved every proposal that the mayor had sent"
    rows = [(f"k{i}", f"{words} {i} times. Residents complained loudly about the pixels.", None) for i in range(3)]
    rows += [("short", "The council met on Monday and approv", None), ("stale", "Residents complained lou", 3), ("bar", f"Council | Town. {words} {words} and residents compl", None), ("digits", "A width of 12pix", None), ("address", "See town.example/resid", None), ("whole", "Residents complained loudly", None)]
    many = [(f"m{i}", f"{'abcdefgh'[i]} " * 15 + "and then the mayor had sent", None) for i in range(8)]
    copies = [(f"c{i}", "The mayor had sent", None) for i in range(9)]
    df = spark.createDataFrame([(i, "a", "T", t, n) for i, t, n in [*rows, *many, *copies]], "id string, author_id string, title string, clean_text string, word_count bigint")
    assert {r.id for r in truncation.found_truncated(df).collect()} == {"short", "stale", "bar", *(i for i, *_ in many)}


def test_furniture_is_counted_by_bodies_and_by_share(spark):
    words = "The council met on Monday and approved every proposal that the mayor had sent. " * 2
    copies = [(f"c{i}", f"a{i}", f"{words}\nThe town hall stood empty on Friday while the whole of the board", None) for i in range(6)]
    sites = [(f"f{i}", "a", f"{words} {i}.\nMore stories about the town", None) for i in range(6)]
    rare = [(f"r{i}", "big", f"{words} {i}.\nRarely seen words about that day", None) for i in range(4)]
    rest = [(f"x{i}", "big", f"Report {i} ended.", None) for i in range(5000)]
    df = spark.createDataFrame([(i, s, "T", t, n) for i, s, t, n in [*copies, *sites, *rare, *rest]], "id string, author_id string, title string, clean_text string, word_count bigint")
    assert {r.id for r in truncation.found_truncated(df).collect()} == {i for i, *_ in [*copies, *rare]}


def page(i: int) -> tuple[str, list[str], list[bool]]:
    rng = np.random.default_rng(i)
    names = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "rstxz"]
    body = [" ".join(rng.choice(names, 25)) + "." for _ in range(4)]
    a, b = names[i], names[i + 60]
    html = f"<html><head><title>x</title></head><body><nav class='n'><a>Home</a></nav><div class='by'>By Ann {i}</div><div class='story'>" + f"<p>{body[0]}</p><div class='ad'>ADVERTISEMENT</div>" + "".join(f"<p>{b}</p>" for b in body[1:]) + f"</div><div class='rail'><p>Most read</p><p>Why {a} left {b}</p></div><footer>© 20{i % 10} Site</footer></body></html>"
    lines = ["Home", f"By Ann {i}", body[0], "ADVERTISEMENT", "", *body[1:], "Most read", f"Why {a} left {b}", f"©  20{i % 10} SITE"]
    return html, lines, [False if x in body or not x else True for x in lines]


def test_page_bodies(spark):
    made = [page(i) for i in range(40)]
    pages = spark.createDataFrame([(f"raw/2011/{i}.html", h) for i, (h, *_) in enumerate(made) if i % 5], "page_path string, html string")
    rows = [(str(i), "https://x.example/a/", f"raw/2011.tar.gz:{i}.html" if i % 2 else f"raw/2011/{i}.html", "\n".join(t)) for i, (_, t, _) in enumerate(made)]
    rows += [rows[3], ("p", "https://x.example/a/", None, "Home"), ("q", None, "raw/2011/q.html", None), ("r", "u", "", "Home")]
    df = spark.createDataFrame(rows, "id string, url string, raw_html_path string, clean_text string")
    got = sorted((r.id, r.line_no) for r in bp.boilerplate_lines(df, pages).collect())
    assert got == sorted((str(i), n) for i, (_, _, bad) in enumerate(made) for n, b in enumerate(bad, 1) if b)
    assert bp.boilerplate_lines(df.limit(0), pages.limit(0)).count() == 0


def pages_with_furniture(n, rng):
    """Pages whose body stands in a container of unique lines, beside a menu, a long notice, tags and links that vary."""
    notice = " ".join("clause" + "x" * k for k in range(90))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    out = []
    for _ in range(n):
        body = [" ".join(word() for _ in range(14)) for _ in range(5)]
        tags, link = f"Tags: {word()}, {word()}", f"Related: {word()} {word()} {word()}"
        menu = ["Home News", "Most read", " ".join(word() for _ in range(5))]
        page = [("nav", menu[0]), ("div.story", body[0]), ("div.story", body[1]), ("div.more", link), *[("div.story", x) for x in body[2:]], ("div.tags", tags), ("aside", menu[1]), ("aside", menu[2]), ("footer", notice)]
        text = [menu[0], *body, link, tags, menu[2], notice]
        out.append((page, "\n".join(text), {1, 7, 8, 9, 10}))
    return out


def test_covered_lines_equal_brute_force():
    rng = np.random.default_rng(8)
    pool = [" ".join("p" * int(rng.integers(1, 40)) for _ in range(int(n))) for n in (1, 2, 5, 62, 63, 64, 65, 200)]
    docs = [[str(rng.choice(pool)) if rng.random() < 0.3 else f"own {i} {k} " + str(rng.integers(0, 9)) for k in range(6)] + ["", "!?"] for i in range(12)]
    covered, _ = bp.covered_lines(docs)
    key = lambda x: tuple(re.findall(r"[^\W_]+", bp.form_of(x).replace("#", " 0 ")))
    seen = collections.defaultdict(set)
    for i, d in enumerate(docs):
        for x in d:
            seen[key(x)].add(i)
    for d, c in zip(docs, covered):
        assert [bool(k) for x, k in zip(d, c) if key(x)] == [len(seen[key(x)]) >= 3 for x in d if key(x)]
    assert bp.covered_lines([]) == ([], []) and [len(c) for c in bp.covered_lines([[], []])[0]] == [0, 0]


def test_what_is_covered_decides(monkeypatch):
    made = pages_with_furniture(40, np.random.default_rng(6))
    ids, texts = [str(i) for i in range(40)], [t for _, t, _ in made]
    pages = ["\x1e".join(f"{c}\x1f{t}" for c, t in p) for p, _, _ in made]
    want = {(str(i), k) for i, (_, _, bad) in enumerate(made) for k in bad}
    assert set(bp.shard_lines(ids, texts, pages)) == want
    real = bp.covered_lines
    monkeypatch.setattr(bp, "covered_lines", lambda s: tuple([np.zeros_like(c) for c in part] for part in real(s)))
    assert not set(bp.shard_lines(ids, texts, pages))


def test_lost_pages_follow_the_others():
    made = pages_with_furniture(60, np.random.default_rng(7))
    ids, texts = [str(i) for i in range(60)], [t for _, t, _ in made]
    pages = [None if i % 6 == 0 else "\x1e".join(f"{c}\x1f{t}" for c, t in p) for i, (p, _, _) in enumerate(made)]
    got = set(bp.shard_lines(ids, texts, pages))
    want = {(str(i), k) for i, (_, _, bad) in enumerate(made) for k in bad}
    assert len(got ^ want) <= 0.05 * len(want)


def test_rows_do_not_hang_on_shards(spark, monkeypatch):
    """Counts, roles and votes are those of the host: an author's note on few pages, lost pages and all, in shards of 5 pages."""
    made = pages_with_furniture(60, np.random.default_rng(7))
    rows, pages = [], []
    for i, (page, text, _) in enumerate(made):
        if i % 12 == 0:
            note = "Ann Example covers the harbour and the town hall for this paper and lives by the sea"
            page, text = [*page, ("div.story", note)], f"{text}\n{note}"
        rows.append((f"id{i}", "https://x.example/a/", f"raw/2011/{i}.html", text))
        pages.append(None if i % 6 == 5 else "\x1e".join(f"{c}\x1f{t}" for c, t in page))
    monkeypatch.setattr(bp, "parsed_pages", lambda pages: pages)
    monkeypatch.setattr(bp, "SHARD_PAGES", 5)
    df = spark.createDataFrame(rows, "id string, url string, raw_html_path string, clean_text string")
    parsed = spark.createDataFrame([(r[2], p) for r, p in zip(rows, pages) if p], "page_path string, page string")
    got = [(r.id, r.line_no) for r in bp.boilerplate_lines(df, parsed).collect()]
    assert len(got) == len(set(got)) and set(got) == set(bp.shard_lines([r[0] for r in rows], [r[3] for r in rows], pages))


def test_votes_of_the_host_decide_as_one_shard(spark):
    """_decided in SQL is _Judge.furniture."""
    rng = np.random.default_rng(5)
    asked = []
    for _ in range(300):
        judge, zone, text = bp._Judge({"by"}), str(rng.choice(list("htmi"))), str(rng.choice(["Topics: roads", "by Ann Example", "A sentence that ends.", "word " * 15, "- an entry", "odd one out"]))
        votes = [tuple(int(x) for x in rng.integers(0, 4, 2)) for _ in range(4)]
        votes = [v if rng.random() < 0.5 else (0, 0) for v in votes]
        for table, key, v in zip(judge.votes, judge.keys(text, zone), votes):
            table[key] = list(v)
        if not judge.keys(text, zone)[3]:
            votes[3] = (0, 0)
        hit = bool(rng.random() < 0.3)
        form, mask, shape, head = votes
        asked.append((form, head, mask, shape, hit, len(text.split()) >= bp.LONG_LINE, judge.edge(text, zone), judge.furniture(text, zone, hit)))
    pair = "struct<body:bigint,bad:bigint>"
    df = spark.createDataFrame(asked, f"form {pair}, head {pair}, mask {pair}, shape {pair}, covered boolean, long boolean, edge boolean, want boolean")
    assert df.filter(~bp._decided().eqNullSafe(df.want)).count() == 0 and 0 < df.filter("want").count() < 300


def test_lines_that_stand_twice_in_a_page_are_counted_by_pages():
    own = iter(range(10**6))
    docs = [[x for k in range(40) for x in (f"notice {'k' * k} ends", f"own {'x' * next(own)}", f"notice {'k' * k} ends", f"own {'x' * next(own)}")] for _ in range(3)]
    covered, _ = bp.covered_lines(docs)
    assert all(c.tolist() == [True, False] * 80 for c in covered)
    assert not any(c.any() for c in bp.covered_lines(docs[:2])[0])


def test_memory_goes_by_chunks(monkeypatch):
    """Neither the words of a shard nor the pages of a batch are held as arrays or lists at once; chunks change no result."""
    docs = [[f"line {'k' * k} of page {'i' * i} " + "word " * 40, "the same foot"] for i in range(40) for k in range(50)]
    want, sizes, real = bp.covered_lines(docs), [], bp.tk.words_of
    monkeypatch.setattr(bp.tk, "words_of", lambda x: (sizes.append(sum(map(len, x.to_pylist()))), real(x))[1])
    got = bp.covered_lines(docs)
    assert sum(sizes) > 400_000 and max(sizes) <= 250_000
    assert all((a == b).all() for x, y in zip(got, want) for a, b in zip(x, y)) and all(c.tolist() == [False, True] for c in got[0])
    html = [f"<div class='story'><p>page {i}</p><p>{'word ' * 20000}</p></div>" for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"page_path": [str(i) for i in range(60)], "html": html})
    parts = list(bp._parsed(iter([batch])))
    assert max(p.nbytes for p in parts) < 1_200_000 and [x for p in parts for x in p.column("page_path").to_pylist()] == [str(i) for i in range(60)]
    assert parts[0].column("page").to_pylist()[0].startswith("div.story\x1fpage 0\x1ediv.story\x1fword")


def test_suffix_array_and_fm_index():
    rng = np.random.default_rng(0)
    text = np.r_[rng.integers(1, 5, 300), 0, rng.integers(1, 5, 200), 0]
    order = suffix_array(text.astype(np.int64), 64)
    assert [tuple(text[i : i + 64]) for i in order] == sorted(tuple(text[i : i + 64]) for i in range(len(text)))
    index = FmIndex(text.astype(np.int64), 64)
    start = np.arange(0, 280, 3)
    lo, hi = index.search(start, start + 7)
    for s, a, b in zip(start, lo, hi):
        want = [i for i in range(len(text) - 6) if (text[i : i + 7] == text[s : s + 7]).all()]
        assert sorted(index.sa[a:b].tolist()) == want
    seq = rng.integers(0, 11, 500)
    w = WaveletMatrix(seq, 4)
    at, c = rng.integers(0, 501, 60), rng.integers(0, 11, 60)
    assert w.rank(c, at).tolist() == [int((seq[:p] == v).sum()) for v, p in zip(c, at)]
