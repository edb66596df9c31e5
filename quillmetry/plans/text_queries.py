"""Text features per document, vector operators and inference statistics, with SQL for both engines.

Words are runs of letters in lower case; sentences end at a terminator followed by white space and a capital, digit or
quotation mark. Features of documents use the documents table; vectors the embeddings, whose label is the entity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetry.operators import drift, ranks
from quillmetry.plans.catalog import query
from quillmetry.plans.dialect import both, spelled
from quillmetry.plans.dialect import rounded as R
from quillmetry.sources.tables import table

#: Phrases of generated prose, of which * stands for some run of characters.
MARKERS = ["it's important to note", "it's worth noting", "delve", "in today's * landscape", "at its core", "a testament to", "in an era of", "plays a crucial role", "it should be noted", "offers a unique", "is a game-changer"]
#: Hedging phrases, counted as substrings.
HEDGES = ["perhaps", "might", "could be argued", "it seems", "appears to", "likely", "possibly", "it is possible", "one could argue", "to some extent"]
#: Function words whose distribution is measured.
FUNCTION_WORDS = "the a is of and to in that it for was on are with as at be this have from by not but what all were when we there can an your which their if do will each about how up out them then she many some so these would".split()
CONJUNCTIONS = "and but or nor for yet so although because since unless while whereas".split()

LETTERS = r"[\pL]+"
SENTENCE_END = r"[.!?]\s+[A-Z0-9\"']"


@both("doc_word_count", "documents")
def _(d):
    return f"select doc_id, case when trim(coalesce(text, '')) = '' then 0 else {d.size}({d.split('trim(' + d.sub('text', '[ ' + chr(92) + 't' + chr(92) + 'n]+', ' ') + ')', ' ')}) end as n from {d.t('documents')}"


@both("doc_content_hash", "documents")
def _(d):
    return f"select doc_id, {d.sha('text')} as digest from {d.t('documents')}"


def words(d) -> str:
    """Words without braces in the pattern, which the parameterised SQL would read as a parameter."""
    return f"select doc_id, {d.all('lower(text)', LETTERS)} as w from {d.t('documents')} where text is not null"


def word_counts(d) -> str:
    return f"w as ({words(d)}), x as (select doc_id, {d.explode}(w) as word from w), c as (select doc_id, word, count(*) as c from x group by 1, 2)"


@both("ttr", "documents")
def _(d):
    return f"with w as ({words(d)}) select doc_id, {R(f'{d.size}({d.distinct}(w)) / cast({d.size}(w) as double)')} as ttr from w where {d.size}(w) > 0"


MATTR_SQL = r"with w as (select doc_id, regexp_extract_all(lower(text), '[\pL]+') as w from documents where text is not null) select doc_id, case when len(w) <= 50 then len(list_distinct(w)) / cast(len(w) as double) else list_sum(list_transform(range(1, len(w) - 48), lambda i: len(list_distinct(list_slice(w, i, i + 49))) / 50.0)) / (len(w) - 49) end as mattr from w where len(w) > 0"


@spelled("mattr", MATTR_SQL, "documents")
def _():
    """Mean type-token ratio over all windows of 50 words; shorter texts have the plain ratio.

    A word counts in the windows that hold it and not its last occurrence before: the gaps to those give the sum over all
    windows in one pass, no window is ever built.
    """
    return r"""with e as (select doc_id, n, i + 1 as i, w from (select doc_id, size(w) as n, posexplode(w) as (i, w) from (select doc_id, regexp_extract_all(lower(text), r'[\pL]+', 0) as w from {documents} where text is not null) x) y),
g as (select doc_id, n, i, coalesce(lag(i) over (partition by doc_id, w order by i), 0) as before from e),
c as (select doc_id, n, greatest(0, least(i, n - 49) - greatest(1, i - 49, before + 1) + 1) as held, case when before = 0 then 1 else 0 end as fresh from g)
select doc_id, case when n <= 50 then sum(fresh) / cast(n as double) else sum(held) / (50D * (n - 49)) end as mattr from c group by doc_id, n"""


@both("lexical_richness", "documents")
def _(d):
    """Words that occur once by all words, Yule's K and Simpson's D."""
    return f"with {word_counts(d)} select doc_id, {R('sum(case when c = 1 then 1 else 0 end) / cast(sum(c) as double)')} as hapax_ratio, {R('case when sum(c) < 2 then null else 10000.0 * (sum(c * c) - sum(c)) / power(sum(c), 2) end')} as yules_k, {R('case when sum(c) < 2 then null else sum(c * (c - 1)) / (cast(sum(c) as double) * (sum(c) - 1)) end')} as simpsons_d from c group by doc_id"


@both("function_word_share", "documents")
def _(d):
    inside = ", ".join(f"'{w}'" for w in sorted(set(FUNCTION_WORDS)))
    return f"with {word_counts(d)} select doc_id, word, {R('c / cast(sum(c) over (partition by doc_id) as double)')} as share from c where word in ({inside})"


def _sentences(d, text: str = "text") -> str:
    return f"(1 + {d.count(f'trim({text})', SENTENCE_END)})"


@both("marker_frequency", "documents")
def _(d):
    hits = " + ".join(d.count("lower(text)", r"\b" + m.replace("*", ".+?") + r"\b") for m in MARKERS)
    return f"select doc_id, {hits} as hits, {R(f'({hits}) / cast({_sentences(d)} as double)')} as per_sentence from {d.t('documents')} where trim(coalesce(text, '')) <> ''"


@both("hedging_frequency", "documents")
def _(d):
    hits = " + ".join(f"(length(t) - length(replace(t, '{h}', ''))) / {len(h)}.0" for h in HEDGES)
    return f"select doc_id, {R(f'({hits}) / n')} as per_sentence from (select doc_id, lower(text) as t, cast({_sentences(d)} as double) as n from {d.t('documents')} where trim(coalesce(text, '')) <> '') x"


#: The first-person words and the phrases of formulas.
FIRST_PERSON = ["i", "me", "my", "mine", "we", "us", "our", "ours"]
OPENING_FORMULAS, CLOSING_FORMULAS = ["in a recent", "it remains to be seen"], ["only time will tell"]


def _among(d, words: str, listed: list[str]) -> str:
    """How many of the words are listed: no word boundary of a pattern, which the engines set differently beside accents."""
    held = ", ".join(f"'{w}'" for w in listed)
    return f"cast({d.size}({d.keep(words, 'x', f'x in ({held})')}) as bigint)"


@both("first_person_ratio", "documents")
def _(d):
    return f"with w as (select doc_id, {d.all('lower(text)', LETTERS)} as w from {d.t('documents')} where text is not null) select doc_id, {R(f'{_among(d, chr(119), FIRST_PERSON)} / cast({d.size}(w) as double)')} as ratio from w where {d.size}(w) > 0"


@both("formula_scores", "documents")
def _(d):
    hit = lambda p: f"case when {d.like('lower(text)', p)} then 1.0 else 0.0 end"
    (a, b), (c,) = ([hit(rf"\b{x}\b") for x in listed] for listed in (OPENING_FORMULAS, CLOSING_FORMULAS))
    return f"select doc_id, {R(f'least(1, ({a} + {b}) / 2)')} as opening, {R(c)} as closing from {d.t('documents')} where text is not null"


ENTROPY_SQL = r"with w as (select doc_id, regexp_extract_all(lower(text), '[\pL]+') as w from documents where text is not null), g as (select doc_id, 2 as n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w union all select doc_id, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w), c as (select doc_id, n, g, count(*) as c from g group by all), t as (select doc_id, n, sum(c) as t from c group by all) select c.doc_id, c.n, -sum(c.c / t.t * log2(c.c / t.t)) as bits from c join t using (doc_id, n) group by 1, 2"


@spelled("ngram_entropy", ENTROPY_SQL, "documents")
def _():
    """Shannon entropy in bits of the bigrams and trigrams of words. What is shuffled are their 64-bit hashes, once."""
    return r"""with w as (select doc_id, transform(regexp_extract_all(lower(text), r'[\pL]+', 0), x -> xxhash64(x)) as w from {documents} where text is not null),
e as (select doc_id, explode(concat(case when size(w) > 1 then transform(sequence(1, size(w) - 1), i -> struct(2 as n, xxhash64(w[i - 1], w[i]) as h)) else array() end, case when size(w) > 2 then transform(sequence(1, size(w) - 2), i -> struct(3 as n, xxhash64(w[i - 1], w[i], w[i + 1]) as h)) else array() end)) as x from w),
c as (select doc_id, x.n as n, x.h as h, cast(count(*) as double) as c from e group by 1, 2, 3)
select doc_id, n, log2(sum(c)) - sum(c * log2(c)) / sum(c) as bits from c group by 1, 2"""


@both("sentence_length_stats", "documents")
def _(d):
    """Words per sentence: number, mean, median, population deviation and biased skewness."""
    marked = d.sub("trim(text)", r"([.!?])\s+([A-Z0-9\"'])", ("$1" if d.explode == "explode" else "\\1") + "\x1e" + ("$2" if d.explode == "explode" else "\\2"))
    return f"with s as (select doc_id, {d.explode}({d.split(marked, chr(30))}) as s from {d.t('documents')} where trim(coalesce(text, '')) <> ''), n as (select doc_id, cast({d.size}({d.all('s', '[' + chr(92) + 'pL' + chr(92) + 'pN]+')}) as double) as n from s) select doc_id, count(*) as sentences, {R('avg(n)')} as mean, {R('median(n)')} as mid, {R('coalesce(stddev_pop(n), 0)')} as std, {R(d.skew('n'))} as skew from n where n > 0 group by 1"


@both("paragraph_shape", "documents")
def _(d):
    """Paragraphs, and mean and population deviation of their words."""
    return f"with p as (select doc_id, {d.explode}({d.split('text', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}) as p from {d.t('documents')} where trim(coalesce(text, '')) <> ''), n as (select doc_id, cast({d.size}({d.all('p', LETTERS)}) as double) as n from p) select doc_id, count(*) as paragraphs, {R('avg(n)')} as mean, {R('stddev_pop(n)')} as std from n group by 1"


@both("punctuation_profile", "documents")
def _(d):
    """Marks per thousand characters."""
    per = lambda c: R(f"1000.0 * (length(text) - length(replace(text, '{c}', ''))) / length(text)")
    marks = {"comma": ",", "stop": ".", "semicolon": ";", "colon": ":", "exclamation": "!", "question": "?", "hyphen": "-"}
    dash = R("1000.0 * (2 * length(text) - length(replace(text, '—', '')) - length(replace(text, '–', ''))) / length(text)")
    return f"select doc_id, {', '.join(f'{per(c)} as {k}' for k, c in marks.items())}, {dash} as dash from {d.t('documents')} where length(text) > 0"


@both("readability_scores", "documents")
def _(d):
    """Flesch-Kincaid, Coleman-Liau, Gunning fog and SMOG by their published formulas; syllables are groups of vowels."""
    w = d.all("lower(text)", "[a-z]+")
    syl = d.map("w", "x", f"greatest(1, {d.count('x', '[aeiouy]+')})")
    return f"with w as (select doc_id, {w} as w, cast({_sentences(d)} as double) as s from {d.t('documents')} where trim(coalesce(text, '')) <> ''), y as (select doc_id, cast({d.size}(w) as double) as n, s, {d.total(d.map('w', 'x', 'cast(length(x) as double)'))} as chars, {d.total(d.map(syl, 'x', 'cast(x as double)'))} as syl, cast({d.size}({d.keep(syl, 'x', 'x >= 3')}) as double) as hard from w where {d.size}(w) > 0) select doc_id, {R('0.39 * n / s + 11.8 * syl / n - 15.59')} as flesch_kincaid, {R('5.88 * chars / n - 29.6 * s / n - 15.8')} as coleman_liau, {R('0.4 * (n / s + 100 * hard / n)')} as gunning_fog, {R('1.043 * sqrt(hard * 30 / s) + 3.1291')} as smog from y"


AUXILIARIES = ["was", "were", "been", "being", "is", "are", "be"]
CLAUSE_MARKS = ["that", "which", "who", "because", "while", "although", "when", "after", "before", "since"]


@both("clause_proxies", "documents")
def _(d):
    """Conjunctions per word, auxiliaries before a word in -ed or -en per sentence, clause marks per sentence: proxies for a parser's labels."""
    held = ", ".join(f"'{w}'" for w in AUXILIARIES)
    follows = d.keep(d.seq("1", f"{d.size}(w) - 1"), "i", f"{d.at('w', 'i')} in ({held}) and ({d.at('w', 'i + 1')} like '_%ed' or {d.at('w', 'i + 1')} like '_%en')")
    return f"with w as (select doc_id, {d.all('lower(text)', LETTERS)} as w, cast({_sentences(d)} as double) as s from {d.t('documents')} where trim(coalesce(text, '')) <> '') select doc_id, {R(f'{_among(d, chr(119), CONJUNCTIONS)} / cast(greatest(1, {d.size}(w)) as double)')} as conjunctions, {R(f'{d.size}({follows}) / s')} as passive, {R(f'{_among(d, chr(119), CLAUSE_MARKS)} / s')} as clauses from w"


@both("word_bigram_top30", "documents")
def _(d):
    """The thirty most frequent pairs of words of each language, ties in order of the pair."""
    arr = d.map(d.seq("1", f"{d.size}(w) - 1"), "i", f"{d.at('w', 'i')} || ' ' || {d.at('w', 'i + 1')}")
    return f"with w as (select lang, {d.all('lower(text)', LETTERS)} as w from {d.t('documents')} where text is not null and lang is not null), g as (select lang, {d.explode}({arr}) as g from w), c as (select lang, g, count(*) as n from g group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, g) as r from c) select lang, g, n from r where r <= 30"


@both("quality_gates", "generated_articles")
def _(d):
    """Generated texts against the words asked for, and the share of their keywords that occur."""
    n = f"{d.size}({d.all('text', LETTERS)})"
    hits = d.keep("topic_keywords", "k", "position(lower(k) in lower(text)) > 0") if d.explode == "unnest" else "filter(topic_keywords, k -> instr(lower(text), lower(k)) > 0)"
    return f"select distinct article_id, abs({n} - target_word_count) <= 0.15 * target_word_count as length_ok, {R(f'case when {d.size}(topic_keywords) > 0 then {d.size}({hits}) / cast({d.size}(topic_keywords) as double) end')} as keyword_share from {d.t('generated_articles')} where text is not null"


@both("coauthor_flag", "authors")
def _(d):
    joined = d.like("lower(name)", r" (?:and|und|y|with|&) ")
    return f"select id, {joined} or (position(',' in name) > 0 and not {d.like('lower(name)', ', (?:jr|sr|phd|md)[.]?$')}) as coauthored from {d.t('authors')}" if d.explode == "unnest" else f"select id, {joined} or (instr(name, ',') > 0 and not {d.like('lower(name)', ', (?:jr|sr|phd|md)[.]?$')}) as coauthored from {d.t('authors')}"


@both("shared_byline", "authors")
def _(d):
    """The first rule that marks a byline as shared: the outlet's name, a staff word, a conjunction."""
    slug = d.sub("lower(outlet)", "[^a-z]+", "-")
    return f"select id, case when slug like {slug} || '%' then 'outlet' when {d.like('slug', '(^|-)(?:staff|newsroom|desk|editors|team|wire)(-|$)')} then 'token' when {d.like('lower(name)', ' (?:and|und|y) ')} then 'conjunction' when is_shared_byline then 'flagged' else 'none' end as rule from {d.t('authors')}"


@both("transient_errors", "raw_pages")
def _(d):
    return f"select coalesce(http_status, 0) as status, coalesce(http_status >= 500 or http_status = 429, false) as transient, count(*) as n from {d.t('raw_pages')} group by 1, 2"


@both("page_headings", "raw_pages")
def _(d):
    """Title and section of stored pages."""
    return f"select page_path, {d.group('html', '<title>([^<]*)</title>', 1)} as title, {d.group('html', 'og:section. content=.([^' + chr(34) + ']*)', 1)} as section from {d.t('raw_pages')}"


@both("year_window", "documents")
def _(d):
    """Rows of whole years as a half-open range."""
    lo, hi = ("timestamptz '2015-01-01 00:00:00+00'", "timestamptz '2019-01-01 00:00:00+00'") if d.explode == "unnest" else ("timestamp'2015-01-01 00:00:00+00:00'", "timestamp'2019-01-01 00:00:00+00:00'")
    return f"select count(*) as n, count(published_at) as dated from {d.t('documents')} where published_at >= {lo} and published_at < {hi}"


# ---- vectors ----


def vec(d) -> str:
    """vec_id, entity, month, position and coordinate of the embeddings."""
    if d.explode == "explode":
        return f"select vec_id, label, cast(floor(vec_id / 50) as int) as month, pos + 1 as pos, cast(v as double) as v from {d.t('embeddings')} lateral view posexplode(embedding) as pos, v"
    return "select vec_id, label, cast(floor(vec_id / 50) as int) as month, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as v from embeddings"


def cosine(a: str, b: str) -> str:
    return f"case when sum({a} * {a}) < 1e-24 or sum({b} * {b}) < 1e-24 then 0.0 else sum({a} * {b}) / (sqrt(sum({a} * {a})) * sqrt(sum({b} * {b}))) end"


@both("month_centroids", "embeddings")
def _(d):
    return f"with v as ({vec(d)}) select label, month, cast(pos as bigint) as pos, {R('avg(v)')} as mean from v group by 1, 2, 3"


@both("centroid_velocity", "embeddings")
def _(d):
    """Cosine distance of an entity's centroid from that of the month before that has one."""
    return f"with v as ({vec(d)}), c as (select label, month, pos, avg(v) as m from v group by 1, 2, 3), l as (select *, lag(m) over (partition by label, pos order by month) as p from c) select label, month, {R('1 - ' + '(' + cosine('m', 'p') + ')')} as velocity from l where p is not null group by 1, 2"


@both("baseline_similarity", "embeddings")
def _(d):
    """Similarity of each vector to the mean of its entity's first twenty."""
    return f"with v as ({vec(d)}), o as (select vec_id, row_number() over (partition by label order by vec_id) as r from {d.t('embeddings')}), b as (select v.label, v.pos, avg(v.v) as m from v join o on v.vec_id = o.vec_id where o.r <= 20 group by 1, 2) select v.vec_id, {R(cosine('v.v', 'b.m'))} as similarity from v join b on v.label = b.label and v.pos = b.pos group by 1"


DISPERSION_SQL = """
with e as (select vec_id, label, cast(floor(vec_id / 50) as int) as month, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
p as (select 'month' as period, label, month, vec_id, v from e union all select 'all', label, cast(null as int), vec_id, v from e),
g as (select period, label, month, count(*) as n from p group by all),
d as (select a.period, a.label, a.month, avg(1 - list_cosine_similarity(a.v, b.v)) as d from p a join p b on a.period = b.period and a.label = b.label and a.month is not distinct from b.month and a.vec_id < b.vec_id group by all),
c as (select period, label, month, pos, avg(x) as m from (select period, label, month, unnest(v) as x, generate_subscripts(v, 1) as pos from p) group by all),
l as (select period, label, month, list(m order by pos) as m from c group by all),
f as (select p.period, p.label, p.month, avg(1 - list_cosine_similarity(p.v, l.m)) as d from p join l on p.period = l.period and p.label = l.label and p.month is not distinct from l.month group by all)
select g.period, g.label, g.month, case when g.n < 2 then 0.0 when g.n <= 20 then d.d else f.d end as dispersion
from g left join d on g.period = d.period and g.label = d.label and g.month is not distinct from d.month
left join f on g.period = f.period and g.label = f.label and g.month is not distinct from f.month"""


@query("intra_month_dispersion", DISPERSION_SQL)
def intra_month_dispersion(spark, sf_dir):
    """Dispersion of an entity's vectors by month and over all: none under 2, mean distance of all pairs up to 20 vectors,
    mean distance to the centroid beyond. Only groups of 20 vectors at most are ever paired."""
    return drift.dispersion(table(spark, sf_dir, "embeddings"))


@both("section_distance_matrix", "embeddings")
def _(d):
    """Cosine distance of every pair of entities' centroids."""
    return f"with v as ({vec(d)}), c as (select label, pos, avg(v) as m from v group by 1, 2) select a.label as a, b.label as b, {R('case when a.label = b.label then 0.0 else 1 - ' + '(' + cosine('a.m', 'b.m') + ') end')} as distance from c a join c b on a.pos = b.pos group by 1, 2"


# ---- inference ----


def sides(d) -> str:
    return f"select user_id as k, event_type as f, value as v, case when ts < {d.ntz(chr(39) + '2024-01-15 00:00:00' + chr(39))} then 0 else 1 end as side from {d.t('events')}"


@both("welch_t", "events")
def _(d):
    """Welch's t, its degrees of freedom and the standardised difference of two periods per entity."""
    q = "v0 / n0 + v1 / n1"
    return f"with s as ({sides(d)}), a as (select k, cast(count(case when side = 0 then v end) as double) as n0, cast(count(case when side = 1 then v end) as double) as n1, avg(case when side = 0 then v end) as m0, avg(case when side = 1 then v end) as m1, var_samp(case when side = 0 then v end) as v0, var_samp(case when side = 1 then v end) as v1 from s group by 1) select k, {R(f'(m1 - m0) / sqrt({q})')} as t, {R(f'power({q}, 2) / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1))')} as df, {R('(m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))')} as d from a where n0 > 2 and n1 > 2 and v0 + v1 > 0"


@both("mann_whitney_u", "events")
def _(d):
    """U of the second period with its tie-corrected normal score."""
    return f"with s as ({sides(d)}), r as (select k, side, v, rank() over (partition by k order by v) + (count(*) over (partition by k, v) - 1) / 2.0 as rk, count(*) over (partition by k, v) as t from s), a as (select k, cast(count(case when side = 0 then 1 end) as double) as n0, cast(count(case when side = 1 then 1 end) as double) as n1, cast(sum(case when side = 1 then rk end) as double) as r1, cast(sum(t * t - 1) as double) as ties from r group by 1), u as (select *, r1 - n1 * (n1 + 1) / 2 as u, n0 + n1 as n from a where n0 > 0 and n1 > 0) select k, {R('u')} as u, {R('(u - n0 * n1 / 2) / nullif(sqrt(n0 * n1 / 12 * ((n + 1) - ties / (n * (n - 1)))), 0)')} as z from u"


@both("kruskal_h", "events")
def _(d):
    """Kruskal-Wallis H over sections with tie correction, and eta squared."""
    return f"with r as (select user_id as k, event_type as s, rank() over (partition by user_id order by value) + (count(*) over (partition by user_id, value) - 1) / 2.0 as rk, count(*) over (partition by user_id, value) as t, count(*) over (partition by user_id) as n from {d.t('events')}), g as (select k, s, cast(max(n) as double) as n, cast(count(*) as double) as c, sum(rk) as rs, sum(t * t - 1) as ties from r group by 1, 2), h as (select k, max(n) as n, count(*) as groups, (12 / (max(n) * (max(n) + 1)) * sum(rs * rs / c) - 3 * (max(n) + 1)) / nullif(1 - sum(ties) / (power(max(n), 3) - max(n)), 0) as h from g group by 1) select k, {R('h')} as h, {R('greatest(0, least(1, (h - groups + 1) / (n - groups)))')} as eta from h where n > groups and groups > 1"


@both("chow_f", "events")
def _(d):
    """F statistic of one linear trend against two, split at the middle of each series."""
    def rss(where: str) -> str:
        c = f"case when {where} then"
        return f"(regr_syy({c} value end, {c} i end) - {d.div(f'power(regr_sxy({c} value end, {c} i end), 2)', f'regr_sxx({c} value end, {c} i end)')})"

    return f"with s as (select user_id, value, cast(row_number() over (partition by user_id order by ts, event_id) as double) as i, cast(count(*) over (partition by user_id) as double) as n from {d.t('events')}), a as (select user_id, max(n) as n, {rss('true')} as p, {rss('i <= floor(n / 2)')} as a, {rss('i > floor(n / 2)')} as b from s group by 1) select user_id, {R('case when coalesce(a + b, 0) <= 0 then 0 else ((p - (a + b)) / 2) / ((a + b) / (n - 4)) end')} as f from a where n >= 6"


PSEUDO_P = "(event_id % 997 + 1) / 1000.0"


def _tests(spark, sf_dir):
    return table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"]).select("event_id", "user_id", F.col("event_type").alias("fam"), F.expr(f"cast({PSEUDO_P} as double)").alias("p"))


def _bh_sql(keys: str, rows: str, part: str) -> str:
    """The checking engine's form: smallest p n / rank of this and every later rank, found by a running minimum from the end."""
    over = f"partition by {part} " if part else ""
    return f"with t as ({rows}), r as (select *, row_number() over ({over}order by p, k) as rk, count(*) over ({over}) as n from t), m as (select *, min(p * n / rk) over ({over}order by rk desc rows between unbounded preceding and current row) as low from r) select {keys}, least(1.0, low) as q from m"


@query("bh_adjusted", _bh_sql("k as event_id", f"select event_id as k, cast({PSEUDO_P} as double) as p from events", ""))
def bh_adjusted(spark, sf_dir):
    """Benjamini-Hochberg over all tests: p n / rank, then the running minimum from the largest p, 1 at most."""
    return ranks.benjamini_hochberg(_tests(spark, sf_dir).select("event_id", "p"), "p", "event_id").select("event_id", "q")


@query("bh_grouped", _bh_sql("k as event_id, fam", f"select event_id as k, event_type as fam, cast({PSEUDO_P} as double) as p from events", "fam"))
def bh_grouped(spark, sf_dir):
    return ranks.benjamini_hochberg(_tests(spark, sf_dir).select("event_id", "fam", "p"), "p", "event_id", ["fam"]).select("event_id", "fam", "q")


@query("bonferroni", f"select event_id, least(1.0, cast({PSEUDO_P} as double) * (select count(*) from events)) as q from events")
def bonferroni(spark, sf_dir):
    return ranks.bonferroni(_tests(spark, sf_dir).select("event_id", "p"), "p").select("event_id", "q")


@query("cross_entity_bh", _bh_sql("k as user_id, fam", f"select user_id as k, event_type as fam, min(cast({PSEUDO_P} as double)) as p from events group by 1, 2", "fam"))
def cross_entity_bh(spark, sf_dir):
    """Each entity's smallest p per family, corrected over the entities of the family."""
    least = _tests(spark, sf_dir).groupBy("user_id", "fam").agg(F.min("p").alias("p"))
    return ranks.benjamini_hochberg(least, "p", "user_id", ["fam"]).select("user_id", "fam", "q")


@both("section_contrast_t", "events")
def _(d):
    """Welch's t for each pair of sections with thirty rows or more."""
    return f"with s as (select event_type as s, cast(count(*) as double) as n, avg(value) as m, var_samp(value) as v from {d.t('events')} group by 1 having count(*) >= 30) select a.s as a, b.s as b, {R('(b.m - a.m) / sqrt(a.v / a.n + b.v / b.n)')} as t from s a join s b on a.s < b.s"


@both("target_vs_controls", "orders", "customer")
def _(d):
    """Each segment against all the others pooled: means and Welch's t, with three rows or more on both sides."""
    return f"with x as (select c.c_mktsegment as s, o.o_totalprice as v from {d.t('orders')} o join {d.t('customer')} c on o.o_custkey = c.c_custkey), a as (select s, cast(count(*) as double) as n, sum(v) as t1, sum(v * v) as t2 from x group by 1), t as (select sum(n) as n, sum(t1) as t1, sum(t2) as t2 from a), b as (select a.s, a.n, a.t1 / a.n as m, (a.t2 - a.t1 * a.t1 / a.n) / (a.n - 1) as v, t.n - a.n as n2, (t.t1 - a.t1) / (t.n - a.n) as m2, ((t.t2 - a.t2) - power(t.t1 - a.t1, 2) / (t.n - a.n)) / (t.n - a.n - 1) as v2 from a cross join t) select s, cast(m as double) as mean, cast(m2 as double) as pooled, cast((m - m2) / sqrt(v / n + v2 / n2) as double) as t from b where n >= 3 and n2 >= 3"


@query("permutation_p", "with m as (select user_id, avg(value) as v from events group by 1) select a.user_id, (sum(case when b.user_id <> a.user_id and b.v >= a.v then 1 else 0 end) + 1) / cast(count(*) as double) as p from m a cross join m b group by 1")
def permutation_p(spark, sf_dir):
    """Empirical p of one entity's mean among those of the others: the others at least as large, and itself, of all."""
    means = table(spark, sf_dir, "events", ["user_id", "value"]).groupBy("user_id").agg(F.avg("value").alias("v"))
    return ranks.share_at_least(means, "v").select("user_id", "p")

