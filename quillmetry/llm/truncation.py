"""Text cut off by field limits (problem 7).

The corpus vocabulary, taken from the titles and from all words but the last of each text, is a trie held as a table of
its nodes: a node is a proper prefix of a known word. A last token that is no word itself but a node of the trie was cut
inside, whatever its line looks like; so was a text of fewer words than word_count says. Any other text that stops
without an end of sentence was cut unless its last line is known to be complete: a list entry, a link, a tag line, a
heading or a line of page furniture, all learned from the corpus by how often their form ends other texts. A length that
many different texts have, and far more than the lengths around it, is evidence against all of these but a whole line
that stands in other texts too.

Defined results: null, empty and blank texts are not cut; a null word_count gives no length evidence. A text of fewer
than `short_text` words needs positive evidence. Repeated rows of one id count once in what is learned and in the rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry.runtime import broadcast_if_small, rows_of, written

#: Longer lines are prose or notices: their form is their exact text, not what is left after masking names and numbers.
PROSE = 240
MARK = r"(?:…|\.\.\.|&hellip;?|\[…\]|\[\.\.\.\]|\(more\))$"
STOP = r"[.!?。！？]$|[.!?。！？,]?[)\]\"”»’'“」]+$"
LIST_ENTRY = r"^(?:[-–•*·] |\d{1,3}[.)] )"
TAG_LINE = r"^\p{L}[\p{L} ]{1,20}: [^.!?\"“”]*,[^.!?\"“”]*$"
#: A last token of letters alone: not what follows digits, nor a part of an address, a name of a file or a tag.
TOKEN = r"(?U)(?:^|\s)[^\s\d@#/\\.:_]*?([\p{L}\p{M}]+)$"
LINK = r"https?://\S+$|\S+@\S+\.\w+$|^#\S+(?: #\S+)*$|[|·©>]"


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"(?U)\d+(?: *[.,] *\d+)*", "9")))


def _template(line: Column, small: Column) -> Column:
    """The line's form: frequent title words and numbers as they are, every other run of words one sign."""
    words = F.split(F.regexp_replace(_normal(line), r"(?U)[^\p{L}\p{N}]+", " "), " ")
    form = F.transform(words, lambda w: F.when((w == "9") | F.array_contains(small, w), w).otherwise(F.lit("w")))
    joined = F.regexp_replace(F.array_join(form, " "), r"w(?: w)+", "w")
    return F.regexp_replace(joined, r"(?: w| 9)+$", "")  # a link adds names or counts to the title


def _mask(line: Column) -> Column:
    """Names and numbers masked: lines of one kind agree whatever they name."""
    joined = F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"(?U)\d+(?: *[.,] *\d+)*", "9"))
    return F.regexp_replace(F.regexp_replace(joined, r"(?U)\b\p{Lu}[\p{L}'’\-]*", "X"), r"X(?: X)+", "X")


def endings(articles: DataFrame) -> DataFrame:
    """One row per article: its last line, last token, lengths and what its end looks like."""
    text = F.regexp_replace(F.coalesce(F.col("clean_text"), F.lit("")), r"(?U)\s+$", "")
    e = articles.withColumn("t", text).filter("t != ''")
    e = e.withColumn("lines", F.split("t", "\n")).withColumn("last", F.trim(F.element_at("lines", -1)))
    # a body is the text without one of its lines, named by the sum of the other lines' hashes
    part = lambda x: F.xxhash64(x) % (1 << 40)
    e = e.withColumn("sum", F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + part(x)))
    body = lambda x: F.col("sum") - part(x)
    e = e.withColumn("body", body(F.element_at("lines", -1)))
    return e.select(
        "id", "author_id", "word_count", "last", "body",
        F.transform(F.filter("lines", lambda x: F.trim(x) != ""), lambda x: F.struct(F.when(F.length(x) <= PROSE, x).alias("line"), F.when(F.length(x) > PROSE, F.xxhash64(F.trim(x))).alias("long"), body(x).alias("body"))).alias("lines"),
        F.length("clean_text").alias("chars"), F.xxhash64("t").alias("text_hash"),
        F.size(F.split(F.regexp_replace("t", r"(?U)\s+", " "), " ")).alias("n_words"),
        F.lower(F.regexp_extract("last", TOKEN, 1)).alias("token"),
        _normal(F.col("last")).alias("normal"),
        _mask(F.col("last")).alias("mask"),
        F.lower(F.regexp_extract("last", r"^([^:.\d]{2,24}): ", 1)).alias("head"),
    )


def vocabulary(articles: DataFrame) -> DataFrame:
    """Distinct words of all titles and texts, without the last word of each text."""
    split = lambda c: F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{M}]+")
    words = split("clean_text")
    inner = F.array_union(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), split("title"))
    return articles.select(F.explode(inner).alias("word")).filter("word != ''").distinct()


def common_lengths(ends: DataFrame, least: int = 5, times: int = 4, around: int = 12) -> DataFrame:
    """chars: lengths of many different texts, `times` as many as the average length and the lengths around have."""
    lengths = ends.groupBy("chars").agg(F.count_distinct("text_hash").alias("c"))
    usual = lengths.agg(F.avg("c")).first()[0] or 0.0
    high = lengths.filter(F.col("c") >= max(float(least), times * usual))
    near = lengths.select(F.explode(F.sequence(F.col("chars") - around, F.col("chars") + around)).alias("chars"), "c").groupBy("chars").agg(F.sum("c").alias("near"))
    return high.join(near, "chars").filter(F.col("c") * (2 * around) >= times * (F.col("near") - F.col("c"))).select("chars")


def trie_nodes(words: DataFrame, least: int = 1) -> DataFrame:
    """Proper prefixes of the words: the inner nodes of their trie."""
    size = F.length("word")
    return words.filter(size > least).select(F.explode(F.transform(F.sequence(F.lit(least), size - 1), lambda n: F.col("word").substr(F.lit(1), n))).alias("node")).distinct()


def heading_forms(articles: DataFrame, common: float = 0.02, least: int = 3) -> tuple[DataFrame, Column]:
    """Forms of titles that at least `least` titles have, and the words that stand in a share `common` of the titles.

    Both are short: a word needs 2 % of the titles, so at most some hundreds of words can be that common.
    """
    titles = articles.select("title").filter("title is not null").distinct()
    n = titles.count()
    words = titles.select(F.explode(F.array_distinct(F.split(F.regexp_replace(_normal(F.col("title")), r"(?U)[^\p{L}\p{N}]+", " "), " "))).alias("w"))
    small = words.filter("w rlike '^[[:alpha:]\\\\p{L}]+$'").groupBy("w").agg(F.count("*").alias("c")).filter(F.col("c") >= max(2.0, n * common)).select("w")
    held = [r.w for r in small.collect()]
    small_words = F.array(*[F.lit(w) for w in held]) if held else F.array().cast("array<string>")
    forms = titles.select(_template(F.col("title"), small_words).alias("form")).groupBy("form").agg(F.count("*").alias("c"))
    return forms.filter((F.col("c") >= least) & (~F.col("form").isin("", "w", "the w", "w the w"))).select("form"), small_words


def furniture(uses: DataFrame, sources: DataFrame, name: str, repeats: int, least: float = 0.001) -> DataFrame:
    """key: forms in `repeats` different bodies at least, in a share `least` of one source's texts at least, and of whose
    uses as last line under 10 % show a sign of a cut. A body (the text without the line) counts once, in one source.
    """
    each = uses.filter("key is not null").groupBy("key", "body").agg(F.min("source").alias("source"), F.max("cut").alias("cut"))
    by_source = each.groupBy("key", "source").agg(F.count("*").alias("c"), F.coalesce(F.sum("cut"), F.lit(0.0)).alias("cut"), F.count("cut").alias("lasts"))
    part = by_source.join(sources, "source").groupBy("key").agg(F.sum("c").alias("c"), F.max(F.col("c") / F.col("texts")).alias("part"), F.sum("cut").alias("cut"), F.sum("lasts").alias("lasts"))
    return part.filter((F.col("c") >= repeats) & (F.col("part") >= least) & ((F.col("lasts") == 0) | (F.col("cut") < 0.1 * F.col("lasts")))).select(F.col("key").alias(name), F.lit(True).alias(f"is_{name}"))


def truncation(articles: DataFrame, repeats: int = 4, short_text: int = 25) -> DataFrame:
    """id, author_id, is_cut, and the evidence: mark, unknown_prefix, fewer_words, common_length. One row per id."""
    a = articles.select("id", "author_id", "title", "clean_text", "word_count")
    ends = written(endings(a).dropDuplicates(["id"]), "ends")
    a_cut = F.col("last").rlike(MARK) | F.coalesce(F.col("word_count") > F.col("n_words") * 1.04 + 2, F.lit(False))
    open_end = ends.withColumns({"mark": F.col("last").rlike(MARK), "stop": F.col("last").rlike(STOP)}).filter("mark or not stop")
    # what ends many texts, hardly ever with a sign of a cut, is furniture; so is a line whose head (Tags:) opens many last lines
    source = F.coalesce(F.col("author_id").cast("string"), F.lit("")).alias("source")
    sources = ends.groupBy("text_hash").agg(F.min(source).alias("source")).groupBy("source").agg(F.count("*").alias("texts"))
    tails = ends.select(source, F.posexplode("lines").alias("i", "x"), F.size("lines").alias("n"), F.col("last"), a_cut.alias("a_cut")).withColumns({"line": F.col("x.line"), "long": F.col("x.long"), "body": F.col("x.body")}).withColumn("is_last", F.coalesce(F.trim("line") == F.col("last"), F.col("long") == F.xxhash64("last")))
    masked = lambda line: F.when((F.length(line) <= PROSE) & F.col("mask").rlike(r"\p{Ll}{3,}"), F.xxhash64("mask"))
    tails = tails.withColumn("mask", _mask(F.col("line"))).select("source", "body", F.coalesce("long", F.xxhash64(_normal(F.col("line")))).alias("line_key"), masked("line").alias("mask_key"), F.when(F.col("is_last") & (F.col("i") == F.col("n") - 1), F.when(F.col("a_cut"), 1.0).otherwise(0.0)).alias("cut"))
    uses = lambda key: tails.select("source", "body", "cut", F.col(key).alias("key"))
    lines, masks = furniture(uses("line_key"), sources, "line_key", repeats), furniture(uses("mask_key"), sources, "mask_key", repeats)
    heads = furniture(ends.filter("head != ''").select(source, "body", F.lit(0.0).alias("cut"), F.col("head").alias("key")), sources, "head", repeats)
    # texts without a head or a token get a key of their own, which nothing matches: one empty key would be a hot one
    own = lambda c: F.when(F.col(c) == "", F.concat(F.lit("\x01"), F.col("id").cast("string"))).otherwise(F.col(c))
    open_end = open_end.withColumns({"head": own("head"), "token": own("token"), "line_key": F.when(F.length("last") > PROSE, F.xxhash64("last")).otherwise(F.xxhash64("normal")), "mask_key": masked("last")})
    spikes = common_lengths(ends).withColumn("common_length", F.lit(True))
    forms, small = heading_forms(a)
    tokens = open_end.filter(~F.startswith("token", F.lit("\x01"))).select("token").distinct()
    words = written(vocabulary(a), "words")
    known = tokens.join(words.withColumnRenamed("word", "token"), "token", "left_semi").withColumn("known", F.lit(True))
    n_tokens = written(tokens, "tokens")
    nodes = trie_nodes(words).join(broadcast_if_small(n_tokens.withColumnRenamed("token", "node"), rows_of(n_tokens)), "node", "left_semi")
    nodes = nodes.select(F.col("node").alias("token"), F.lit(True).alias("is_node"))
    joined = (
        open_end.join(lines, "line_key", "left").join(masks, "mask_key", "left").join(heads, "head", "left").join(spikes, "chars", "left")
        .withColumn("form", _template(F.col("last"), small)).join(forms.withColumn("heading", F.lit(True)), "form", "left")
        .join(known, "token", "left").join(nodes, "token", "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    prefix = yes("is_node") & ~yes("known")
    fewer = F.coalesce(F.col("word_count") > F.col("n_words") * 1.04 + 2, F.lit(False))
    complete = F.col("last").rlike(LIST_ENTRY) | F.col("last").rlike(LINK) | F.col("last").rlike(TAG_LINE) | yes("is_mask_key") | yes("is_head") | yes("heading")
    cut = (
        F.when(F.col("mark"), ~yes("is_line_key") & (F.col("n_words") >= 5)).when(prefix | fewer, True).when(yes("is_line_key"), False)
        .when(yes("common_length"), True).when(complete, False).otherwise(F.col("n_words") >= short_text)
    )
    return joined.select("id", "author_id", cut.alias("is_cut"), "mark", prefix.alias("unknown_prefix"), fewer.alias("fewer_words"), yes("common_length").alias("common_length"), "last")


def found_truncated(articles: DataFrame) -> DataFrame:
    return truncation(articles).filter("is_cut").select("id")


def truncation_rates(articles: DataFrame, authors: DataFrame) -> DataFrame:
    """Of each author: outlet, articles, cut articles and their share. Articles without text count as not cut."""
    cut = found_truncated(articles).withColumn("cut", F.lit(1))
    all_ids = articles.select("id", "author_id").dropDuplicates(["id"])
    out = all_ids.join(cut, "id", "left").groupBy("author_id").agg(F.count("*").alias("articles"), F.count("cut").alias("cut"))
    return out.join(authors.select(F.col("id").alias("author_id"), "outlet"), "author_id", "left").select("author_id", "outlet", "articles", "cut", (F.col("cut") / F.col("articles")).alias("rate"))
